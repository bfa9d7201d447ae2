"""Awkward documents for every operator."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, label int, id string, bucket long, found string"
PROSE = " ".join(f"word{i} and then some" for i in range(60))


def awkward_rows():
    texts = [None, "", "   \n\t ", "x", "one two three", PROSE, PROSE, PROSE.replace("word7 ", "other "), "é" * 5 + " ünï 中文 😀 text", "a b c " * 9000, "Tab\tand\x0bvertical\x0cfeeds\r\nlines\n\nlines\n\nlines"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t), "w", 1, "i", 2, None) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, PROSE, "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
