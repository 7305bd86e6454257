"""Small awkward tables that every operator must take, and brute-force helpers."""

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, name string, sha string, key string, kept boolean, n bigint"


def awkward_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, and columns whose names the
    operators use inside."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(120))
    near = base.split(" ")
    near[60] = "changed"
    long = " ".join(word() for _ in range(30_000))
    texts = [base, base, base.upper(), " ".join(near), None, "", " \n\t ", "one two", "ONE TWO", "one two three four five", long, long + " tail", "日本語 テキスト", "a\x1cb\x00c", "x" * 5000]
    rows = [(i, t, "en", "src0", len(t or ""), "n", "s", "k", True, 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_components(rows, size, num, den):
    """[(doc_id, set size, smallest doc_id reachable)] in the order of ``rows``."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
