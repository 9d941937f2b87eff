"""Document tables for the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, a long"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 2}" if i % 5 else None, len(t or ""), None, None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edit_distance(a, b, cap=8):
    """Edits between two strings, or cap + 1 for more; only the diagonals within ``cap`` are filled."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    row = {j: j for j in range(min(cap, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - cap), min(len(b), i + cap) + 1):
            new[j] = i if j == 0 else min(new.get(j - 1, cap) + 1, row.get(j, cap) + 1, row.get(j - 1, cap) + (x != b[j - 1]))
        row = new
    return min(row[len(b)], cap + 1)


def survivor(found, place):
    """Where the chain of earliest lines that starts at ``place`` ends."""
    while place in found:
        place = found[place][:2]
    return place
