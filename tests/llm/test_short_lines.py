from grainfold.llm import line_dedup


def test_exact_copies_of_short_lines_go_where_asked(frame):
    long = "a line of more than twenty characters"
    texts = [f"Read more\n\n{long}\nx", f"Read more\n  \n{long}!\nx", "Read mora\n\n  \nRead more"]
    got = {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in line_dedup.line_dedup(frame(texts), exact_chars=1).collect()}
    assert got == {0: (texts[0], 0, 0), 1: ("  ", 2, 1), 2: ("Read mora\n\n  ", 1, 0)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame(texts)).collect()}
    assert got == {0: texts[0], 1: "Read more\n  \nx", 2: texts[2]}
