import pytest

from marketweave.llm.split import split_text

TEXTS = [
    "short", "", None, "A sentence here. " * 400, "line\n" * 900, "x" * 10_000, "é́" * 3000, "😀" * 5000, "para one.\n\n" * 500, " " * 7000, "a" * 3000, "a" * 3001, "word " * 100_000, "\n" * 4000,
]


@pytest.mark.parametrize("limit, overlap", [(3000, 200), (100, 0), (100, 30)])
def test_round_trip(spark, limit, overlap):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "seq long, body string, start int, piece int")
    rows = sorted(split_text(df, "seq", "body", limit, overlap).collect(), key=lambda r: (r.seq, r.piece_no))
    for i, text in enumerate(TEXTS):
        got = [r for r in rows if r.seq == i]
        if text is None:
            assert not got
            continue
        assert [r.piece_no for r in got] == list(range(1, len(got) + 1)) and all(r.n_pieces == len(got) for r in got)
        assert all(len(r.piece) <= limit and text[r.start:r.start + len(r.piece)] == r.piece for r in got)
        whole = got[0].piece
        for a, b in zip(got, got[1:]):
            assert b.piece[:overlap] == a.piece[len(a.piece) - overlap:]
            assert len(b.piece) > overlap
            whole += b.piece[overlap:]
        assert whole == text


def test_boundaries(spark):
    df = spark.createDataFrame([(1, "First part is here. Second part runs on and on and on"), (2, "one two three four five six seven")], "seq long, body string")
    got = {(r.seq, r.piece_no): r.piece for r in split_text(df, "seq", "body", 30, 0).collect()}
    assert got[1, 1] == "First part is here. " and got[2, 1] == "one two three four five six "


def test_only_over_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 31), (2, "a" * 30)], "seq long, body string")
    assert {r.seq for r in split_text(df, "seq", "body", 30, 5, only_over=True).collect()} == {1}
    assert split_text(df.limit(0), "seq", "body").count() == 0
    with pytest.raises(ValueError):
        split_text(df, "seq", "body", 30, 10)


def test_an_early_boundary_is_better_than_none(spark):
    texts = ["a" * 900 + ". " + "b" * 4000, "x" * 250 + ". " + "“ok.”" + ")" * 5 + " " + "c" * 4000, "p" * 300 + "\n" + " " * 20 + "\n" + "d" * 3500, "a" * 2000 + " " + "b" * 1500 + ". " + "c" * 2000, "short. " + "e" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, body string")
    first = {r.seq: len(r.piece) for r in split_text(df, "seq", "body").filter("piece_no = 1").collect()}
    assert first == {0: 902, 1: 263, 2: 322, 3: 2001, 4: 3000}
