import numpy as np

from marketweave.llm import residue as R
from tests.llm.test_residue import OTHER, PROSE

PHRASES = ["HTTP 503 Service Unavailable", "The page you are looking for does not exist.", "Please turn on JavaScript to continue.", "An error has occurred. Reference #18.2f", "Página não encontrada",
           "Our servers are experiencing difficulties. Try again later.", "Sorry, this story could not be loaded because the server is having trouble.", "Content goes here.", "Enter your text here"]


def found(spark, rows):
    return {r.seq for r in R.residue_articles(spark.createDataFrame(rows, "seq long, body string")).collect()}


def test_single_pages(spark):
    rows = list(enumerate([*PHRASES, "x {{ " + "n" * 90 + " }} y", "<" + "b " * 60 + ">404 Not Found", "The ministry said a page was not found to be at fault.", ""]))
    assert found(spark, rows) == set(range(len(PHRASES) + 2))


def test_labels_spread_to_what_stands_with_them(spark):
    """Headings and causes that no seed knows are told by the messages that they make up with known ones."""
    heads, causes = ["404 Not Found", "Gatekeeper says no", "503 Service Unavailable"], ["the story kiln went cold today", "a clerk lost the ledger of pages", "nobody fed the page engine"]
    rows = [(i, f"{heads[i // 3 * 2]}: {c} (X{i}7)") for i, c in enumerate(causes * 2)]
    rows += [(100 + i, f"{heads[1]}: {c} (X{i}7)") for i, c in enumerate(causes)]
    rows += [(200, f"{heads[1]}: it is shut for repairs"), (201, f"{PROSE}\n{OTHER} {heads[0]}: it is shut"), (202, PROSE), (203, OTHER)]
    assert found(spark, rows) == {*range(6), 100, 101, 102, 200}
    units = R.text_units(spark.createDataFrame(rows, "seq long, body string"), "seq", "body")
    assert {r.id for r in units.filter("label > 0").select("id").collect()} == {*range(6), 201}


def test_keys_do_not_depend_on_the_batch():
    texts = [f"{PROSE} {i} {OTHER}" for i in range(40)]
    v = R.Vocabulary()
    whole = R.Units(v, texts)
    every = whole.prefixes(np.arange(len(whole.hash)))
    alone = [R.Units(v, [t]) for t in texts]
    each = [u.prefixes(np.arange(len(u.hash))) for u in alone]
    assert every[0].tolist() == [k for e in each for k in e[0].tolist()] and every[2].tolist() == [n for e in each for n in e[2].tolist()]
