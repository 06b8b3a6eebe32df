"""Plumbline: architecture-policy analytics over fact tables, expressed as Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame; nothing is collected to the driver
except convergence counts, bounded policy tables and rendered reports.
"""
