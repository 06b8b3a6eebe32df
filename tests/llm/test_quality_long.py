from plumbline.llm import quality as m


def test_whole_long_tokens_enter_the_shape():
    head = "https://a.b/" + "x1" * 40
    assert m.shape(head + "?Q=7") != m.shape(head + "#q") and m.shape(head + "?Q=7").endswith("?A=9")
    assert m.shape("a" * 100_000 + "!!!!") == "a!!!"
