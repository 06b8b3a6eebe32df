"""Contracts and locks: TOML files that the driver reads, as nested dicts.

They are policy, written by hand and small; limits keep them so. Fact tables never pass here.
"""
from __future__ import annotations

import hashlib
import json
import os
import tomllib

#: How deep imports may go, how many files and bytes they may be, and which sections fragments may add rows to.
MAX_DEPTH, MAX_FILES, MAX_BYTES = 64, 256, 16 << 20
APPENDED = ("layers", "scopes", "owners", "dependency_rules", "gates", "invariants", "ratchets")

#: Sections of a lock and the fields that order their rows.
SECTIONS = {
    "packages": ("name",), "generated": ("root",), "gates": ("name",), "execution_receipts": ("production", "test", "name"), "macro_sources": ("allowance",),
    "macro_implementations": ("directory", "package"), "item_macro_manifests": ("name", "invocation_path"), "ratchets": ("rule", "selector", "target"),
}


class ContractError(ValueError):
    pass


def relative(path: str) -> str:
    """A path without `.` and empty parts; an error for one that is absolute, has a backslash or leaves its root."""
    if path.startswith("/") or "\\" in path or ".." in path.split("/"):
        raise ContractError(f"path leaves the repository: {path!r}")
    return "/".join(x for x in path.split("/") if x not in ("", "."))


def read_contract(root: str, path: str) -> tuple[dict, list[tuple[str, str]]]:
    """A contract with what it imports merged in, and (path, sha256) of its files in the order they are read.

    Imports are paths from the root; each file is read once, and a file that leads back to itself or is imported twice is an
    error, as are more files, bytes or levels than the limits. Schema 2 takes no patterns in imports.
    """
    seen: list[tuple[str, str]] = []
    total = 0

    def load(name: str, above: tuple[str, ...]) -> dict:
        nonlocal total
        name = relative(name)
        if name in above:
            raise ContractError("contract import cycle: " + " -> ".join((*above[above.index(name) :], name)))
        if name in (x for x, _ in seen):
            raise ContractError(f"contract file {name!r} is imported more than once")
        if len(above) >= MAX_DEPTH or len(seen) >= MAX_FILES:
            raise ContractError(f"contract imports exceed {MAX_DEPTH} levels or {MAX_FILES} files")
        with open(os.path.join(root, name), "rb") as f:
            data = f.read(MAX_BYTES + 1 - total)
        total += len(data)
        if total > MAX_BYTES:
            raise ContractError(f"contract sources exceed {MAX_BYTES} bytes")
        seen.append((name, hashlib.sha256(data).hexdigest()))
        try:
            doc = tomllib.loads(data.decode())
        except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
            raise ContractError(f"contract {name!r}: {e}") from e
        imports = doc.pop("imports", [])
        if any(set("*?[") & set(x) for x in imports):
            raise ContractError(f"contract {name!r} imports a pattern; name each file")
        for x in imports:
            doc = merge(doc, load(x, (*above, name)), relative(x))
        return doc

    return load(path, ()), seen


def merge(doc: dict, fragment: dict, name: str) -> dict:
    """A contract with a fragment: rows of appended sections follow, tables join field by field, and a field that both set is an error."""
    out = dict(doc)
    for key, value in fragment.items():
        if key == "schema":
            if value != doc.get("schema", value):
                raise ContractError(f"{name!r} has another schema")
        elif key not in out:
            out[key] = value
        elif key in APPENDED and isinstance(value, list):
            out[key] = [*out[key], *value]
        elif isinstance(value, dict) and isinstance(out[key], dict):
            out[key] = merge(out[key], value, f"{name}:{key}")
        elif isinstance(value, list) and isinstance(out[key], list) and all(isinstance(x, dict) for x in [*value, *out[key]]):
            out[key] = [*out[key], *value]
        else:
            raise ContractError(f"{name!r} sets {key!r} again")
    return out


def canonical(lock: dict) -> dict:
    """A lock with its sections' rows, and the lists in them, in their canonical order; rows that differ in nothing count once."""
    out = dict(lock)
    for section, keys in SECTIONS.items():
        if section in out:
            rows = {json.dumps(r, sort_keys=True): {k: sorted(v, key=lambda x: json.dumps(x, sort_keys=True)) if isinstance(v, list) else v for k, v in r.items()} for r in out[section]}
            out[section] = sorted(rows.values(), key=lambda r: ([(r.get(k) is not None, str(r.get(k, ""))) for k in keys], json.dumps(r, sort_keys=True)))
    return out


def read_lock(path: str) -> dict | None:
    """A lock in canonical order; None if there is no such file."""
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        return canonical(tomllib.load(f))


def _value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{k} = {_value(x)}" for k, x in v.items()) + " }"
    return str(v)


def render_lock(lock: dict) -> str:
    """A lock as TOML, in canonical order: equal locks give equal texts, and reading a text gives its lock."""
    lock = canonical(lock)
    lines = [f"{k} = {_value(v)}" for k, v in lock.items() if k not in SECTIONS and not isinstance(v, dict)]
    for k, v in lock.items():
        if k not in SECTIONS and isinstance(v, dict):
            lines += ["", f"[{k}]", *[f"{a} = {_value(b)}" for a, b in v.items()]]
    for section in SECTIONS:
        for row in lock.get(section, ()):
            lines += ["", f"[[{section}]]", *[f"{a} = {_value(b)}" for a, b in row.items() if b is not None]]
    return "\n".join(lines) + "\n"


def replace_file(path: str, planned: bytes | None, new: bytes) -> None:
    """Writes a file at once, only if it still holds the bytes that were planned for (None: no file); else an error (K7)."""
    now = open(path, "rb").read() if os.path.exists(path) else None
    if now != planned:
        raise ContractError(f"{path!r} changed since it was planned")
    part = f"{path}.{os.getpid()}.part"
    try:
        with open(part, "xb") as f:
            f.write(new)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)
