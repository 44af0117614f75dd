from marketweave.llm import residue as R

PROSE = ("The next crop made its late plan before noon, so the fleet fed their safe port in the rain. A small board sold the new mill to the north, and "
         "every guard drew its rich ship after the storm at a low price. The weak loan met the long rate, which the poor union won last week without any fuss at all.")
OTHER = ("One broker told a forum that the cold cargo took its long bond as a view of the tough rate. Two envoys then put the toll of the great gate at a third of "
         "what the main tribe gave for the whole army last spring, and nobody in the late town asked for the notes of that day or of any other.")
LONG = ("Scripts are disabled in this reader and the article of the day will only be shown once you allow them to run for all pages of this outlet and of the "
        "partners that deliver its charts quotes and tables")
ROWS = {
    1: PROSE, 2: None, 3: "", 4: "  \n ", 5: "404 Not Found. The requested page /a1 was not found on this server.", 6: "Outlet line\r\nSCRIPTS ARE DISABLED: switch them on and load the page once more (A-9)",
    7: PROSE + "\nVisitors saw a \"404 Not Found\" message for 6696 hours, he said.", 8: OTHER + "\n404 Not Found", 9: "x {{ lead_rate }} y", 10: PROSE + " [INSERT TITLE HERE] end.",
    11: PROSE + "\nLorem ipsum dolor sit amet. Sed do eiusmod tempor ut labore.\n" + PROSE, 12: PROSE + "\nThe brochure still had lorem ipsum under photo 3.",
    13: 'He said "we will not [the committee] sign" and a <form> cost $12 & 5%.', 14: PROSE + " %SECTION_LABEL% " + PROSE, 15: "xxxx xxxx xxxx xxxx [a1] asdf asdf test test",
    16: "Java​Script is turned off in your browser; turn it on and reload page 7", 17: "Die Zeile " + PROSE, 18: "Hier gilt 100 % Rabatt und 50 % mehr",
    19: LONG, 20: LONG.replace("Scripts are", "Programs are", 1), 21: "word " * 50_000, 22: "a" * 300_000,
}
FOUND = {5, 6, 9, 10, 11, 14, 15, 16, 19, 20}


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "n", 1) for k, v in rows], "seq long, body string, id string, h int")


def test_found(spark):
    got = {r.seq: r.kind for r in R.residue_articles(frame(spark, ROWS.items())).collect()}
    assert set(got) == FOUND
    assert got[9] == "placeholder" and got[11] == "filler" and got[5] == "notice"


def test_label_spreads_to_near_duplicates():
    assert R.Units(R.Vocabulary(), [ROWS[19]]).label(0) == R.NOTICE
    assert R.Units(R.Vocabulary(), [ROWS[20]]).label(0) == 0  # found above through the component of 19


def test_repeated_rows_and_empty(spark):
    assert R.residue_articles(frame(spark, [(5, ROWS[5])] * 3 + [(None, ROWS[5])])).count() == 1
    assert R.residue_articles(frame(spark, [])).count() == 0


def test_decoys_have_no_placeholder():
    for text in ("{sic }", "100% of $5 and $6", "a < b > c", "[sic]", "5 % x 6 %", "f(x) = {1, 2}", "a__b"):
        assert R.has_placeholder(text) is None, text
    for text in ("{{a}}", "{% if x %}", "<%= x %>", "${a.b}", "#{x}", "{city}", "[[x]]", "<<X>>", "@@x@@", "__X__", "%X_Y%", "$X_Y$", "*|X|*", "[your quote 1]", "[quote 1 TK]"):
        assert R.has_placeholder(f"a {text} b") == text
