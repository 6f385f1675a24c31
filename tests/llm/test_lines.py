"""Line dedup against its SQL twin and a plain version."""

from collections import defaultdict

from corpusmith.llm import lines


def brute(rows, sites):
    """rows: (id, text, site)."""
    where, first = defaultdict(set), {}
    for d, t, s in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip():
                where[line].add(s)
                first[line] = min(first.get(line, (d, k)), (d, k))
    out = []
    for d, t, _ in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(where[x]) < sites or first.get(x) == (d, k))
        out.append((d, kept))
    return sorted(out, key=repr)


def test_like_brute_force(spark, docs):
    rows = []
    for k in range(40):
        body = [f"own line {k}", "seen on all", "", f"shared by few {k % 3}"] + ["on eight sites"] * (k < 8) + ["on seven sites"] * (k < 7) + ["one site only"] * (k % 10 == 0)
        rows.append((k, "\n".join(body + ["seen on all"]), f"s{0 if k % 10 == 0 and k > 8 else k}"))
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n \n", "s3"), (103, "seen on all", None)]
    table = docs(rows)
    got = lines.dedup(table, sites=8)
    assert got.columns == [*table.columns, "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(rows, 8)
    assert lines.dedup(docs([])).count() == 0


def test_repeated_rows(spark, docs):
    rows = [(k, "common line\nown %d" % k, f"s{k}") for k in range(9)] * 2
    got = [(r.doc_id, r.text) for r in lines.dedup(docs(rows)).collect()]
    assert len(got) == 18 and sorted(set(got)) == [(0, "common line\nown 0")] + [(k, f"own {k}") for k in range(1, 9)]


def test_exact_band(spark, docs):
    """Around the threshold the exact count decides."""
    for n in (7, 8, 9):
        rows = [(k, "the line", f"s{k}") for k in range(n)] + [(100 + k, f"own {k}", f"t{k}") for k in range(30)]
        _, found = lines.boilerplate(docs(rows))
        assert found.count() == (n >= 8)


def test_carriage_returns_and_blank_lines(spark, docs):
    rows = [(k, f"own {k}\r\n\r\nmore {k}\r\n \t\r\nshared\r\n" if k % 2 else f"own {k}\n\nmore {k}\nshared", f"s{k}") for k in range(9)]
    got = {r.doc_id: r.text for r in lines.dedup(docs(rows)).collect()}
    assert got == {0: rows[0][1]} | {k: t.replace("shared\r\n", "").replace("\nshared", "") for k, t, _ in rows[1:]}


def test_few_sites(spark, docs):
    """The threshold follows the number of sites."""
    for sites, want in ((1, 3), (5, 3), (9, 4), (20, 8), (500, 8)):
        assert lines.threshold(docs([(k, "x", f"s{k % sites}") for k in range(sites * 2)])) == want
    rows = [(k, f"own {k}\nseen all over", f"s{k % 4}") for k in range(40)]
    assert sum("seen all over" in r.text for r in lines.dedup(docs(rows)).collect()) == 1


def test_clashing_names(spark, docs):
    rows = [(k, f"own {k}\nseen all over", f"s{k}") for k in range(9)]
    table = docs(rows)
    for name in ("__id", "__whole", "__gone", "id", "line", "first", "n_lines"):
        table = table.withColumn(name, table.doc_id)
    got = lines.dedup(table)
    assert got.columns == [*(c for c in table.columns if c != "n_lines"), "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r["__gone"]) for r in got.collect()} == {0: ("own 0\nseen all over", 0)} | {k: (f"own {k}", k) for k in range(1, 9)}


def test_long_documents(spark, docs):
    """Time in proportion: many repeated lines in one document, and a text of 10 MB."""
    import time

    took = []
    for n in (20_000, 80_000):
        rows = [(k, "over and over", f"s{k}") for k in range(9)] + [(99, "over and over\n" * n + "own", "s1"), (100, "long line " * (n * 6), "s2")]
        start = time.perf_counter()
        got = {r.doc_id: (len(r.text), r.n_removed) for r in lines.dedup(docs(rows)).collect()}
        took.append(time.perf_counter() - start)
        assert got[99] == (3, n) and got[100] == (n * 60, 0)
    assert took[1] < 5 * took[0] + 5
