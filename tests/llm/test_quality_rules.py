import random
import re
from collections import defaultdict

from tidemark.llm import quality_rules as q

CLEAN = "The quick brown fox jumps over the lazy dog while the rain falls on the old stone bridge near the mill. "


def counts_of(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    t = text or ""
    w = word.findall(t)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {p + k for own in places.values() if len(own) > 1 for p in own for k in range(5)}
    lines = [x for x in t.split("\n") if word.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one two three four five", "a b c d e a b c d e", "a a a a a a a", "x y z a b c d e q a b c d e r s t", "same line\nsame line\n\n \nsame line",
    "ein Wörter# mit $ymbol <b> | & % 🙂", CLEAN * 3, "l1 a\u00a0b\u2003c d e\x0bf\x0cg\r\nh", " ".join(str(i % 977) for i in range(9000)), "a b c d e f\na b c d e g a b c d e f",
]


def test_counts_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    got = q.counted(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts_of(TEXTS[r["doc_id"]]), r["doc_id"]


def _corpus():
    rng = random.Random(4)
    names = "stone river garden window bridge market letter morning engine harbour valley copper silver winter summer island".split()
    word = lambda: rng.choice(names) + rng.choice(("", "s", "ed", "ly"))
    good = [(i, " ".join(word() + ("." if k % 8 == 7 else "") for k in range(64 + i % 40))) for i in range(80)]
    symbols = [(100 + i, " ".join(word() + rng.choice(("###", "$$$", "%%%")) for _ in range(60))) for i in range(12)]
    lists = [(200 + i, " | ".join(word() for _ in range(60))) for i in range(12)]
    return good, symbols + lists


def test_rules_separate_good_from_bad(spark):
    good, bad = _corpus()
    counted = q.counted(spark.createDataFrame(good + bad, "doc_id long, text string"))
    model = q.fit_on(counted)
    kept = {r["doc_id"] for r in q.judge(counted, model).where("kept").collect()}
    assert {i for i, _ in good} <= kept and not {i for i, _ in bad} & kept


def test_posterior_columns_equal_the_model(spark):
    good, bad = _corpus()
    counted = q.counted(spark.createDataFrame(good[:9] + bad[:9], "doc_id long, text string"))
    model = q.fit_on(counted)
    for r in q.judge(counted, model).withColumn("votes", q.pattern()).collect():
        assert abs(r["quality"] - model.posterior(r["votes"])) < 1e-12


def test_empty_table(spark):
    counted = q.counted(spark.createDataFrame([], "doc_id long, text string"))
    assert q.judge(counted, q.fit_on(counted)).collect() == []


def test_clean_documents_alone_are_kept(spark):
    good, _ = _corpus()
    counted = q.counted(spark.createDataFrame(good, "doc_id long, text string"))
    assert q.judge(counted, q.fit_on(counted)).where("kept").count() == len(good)
