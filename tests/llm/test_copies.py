from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketweave.llm import merkle

SCHEMA = "seq long, title string, url string, copies string, _root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    fold = lambda t: "".join(c for c in t.casefold() if c.isalnum())
    groups = defaultdict(list)
    for seq, title, url in rows:
        if title is None or url is None:
            continue
        path, _, query = url.partition("?")
        pairs = {(fold(n), fold(v)) for n, _, v in (p.partition("=") for p in query.replace(";", "&").split("&"))} - {("", "")}
        groups[fold(title), fold(path), frozenset(pairs)].append(seq)
    return {(min(g), s) for g in groups.values() for s in g if s != min(g)}


ROWS = [
    (1, "A title, here", "https://a.example/x-y?b=2&a=1"), (2, "a TITLE here!", "HTTPS://A.example//x_y/?a=1&b=2"), (3, "A title here", "https://a.example/x-y?b=1&a=2"),
    (4, None, "https://a.example/x-y"), (5, None, "https://a.example/x-y"), (6, "A title here", "https://a.example/x-y?&a=1&b=2&a=1"), (7, "Große Lage", "u"), (8, "GROSSE LAGE", "U"),
    (9, "", "v"), (10, "?!", "v"), (11, "t", "https://a.example/x?a=1b"), (12, "t", "https://a.example/x?a1=b"), (13, "A title, here", "https://a.example/x-y?b=2&a=1"),
]


def test_pairs(spark):
    got = {tuple(r) for r in merkle.copy_pairs(frame(spark, ROWS)).collect()}
    assert got == brute(ROWS) == {(1, 2), (1, 6), (1, 13), (7, 8), (9, 10)}


def test_collapse(spark):
    got = {r.seq: r.copies for r in merkle.collapse(frame(spark, ROWS)).collect()}
    assert got[1] == 4 and got[4] == got[5] == 1 and sum(got.values()) == len(ROWS)


def test_empty_and_repeated(spark):
    assert merkle.copy_pairs(frame(spark, [])).count() == merkle.collapse(frame(spark, [])).count() == 0
    assert merkle.copy_pairs(frame(spark, [(1, "a", "b")] * 3)).count() == 0
    long = "x" * 200_000
    assert merkle.copy_pairs(frame(spark, [(1, long, "b"), (2, long.upper(), "b?")])).count() == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["A b", "a-B", "c", None]), st.sampled_from(["u?x=1", "U?X=1&", "u?x=1&y=2", "u?y=2&x=1", "u"])), max_size=12))
def test_against_brute_force(spark, pairs):
    rows = [(i, *p) for i, p in enumerate(pairs)]
    assert {tuple(r) for r in merkle.copy_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_hot_group(spark):
    rows = [(i, "Same TITLE" if i % 3 == 0 else f"t{i}", "u?a=1" if i % 2 else "U?a=1&") for i in range(3000)]
    got = merkle.copy_pairs(frame(spark, rows)).collect()
    assert len(got) == 999 and {r.seq_first for r in got} == {0}
    sizes = sorted(r.copies for r in merkle.collapse(frame(spark, rows)).collect())
    assert sizes[-1] == 1000 and sum(sizes) == 3000
