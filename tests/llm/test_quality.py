import re
from collections import Counter

from ticketloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(win)
    cover = {j for i, x in enumerate(win) if count[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_base_figures(docs):
    got = quality.verdicts(docs).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.kept and r.base_failed) for r in got)


def test_common_lines_go_and_copies_stay(spark):
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    body = lambda i, n: " ".join(f"w{letters(i)}x{letters(j)}" for j in range(n))
    rows = [(i, f"{body(i, 60)}\nShared  LINE 12 here\n{body(i + 1000, 5)}", "s") for i in range(30)]
    rows += [(100 + i, body(7777, 30) + "\n" + body(8888, 40), "s") for i in range(60)]
    rows += [(200, "Shared line 7 here\n" + " ".join(["Shared line 9 here"] * 1) + "\n" + body(5, 55), "s")]
    rows += [(300, "\n".join(["Shared line %d here" % (k % 9) for k in range(40)]), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.assess(df).select("doc.doc_id", "quality.*").collect()}
    assert all(out[i].kept and out[i].lost_words == 4 and "LINE" not in out[i].text for i in range(30))
    assert all(out[100 + i].kept and out[100 + i].lost_words == 0 for i in range(60))
    assert out[200].kept and out[200].lost_words == 8
    assert not out[300].kept


def test_blocks_and_lines_between_blank_lines(spark):
    """A line between blank lines in half of a host's documents goes, and so does a header of three lines."""
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    body = lambda i: " ".join(f"w{letters(i)}x{letters(j)}" for j in range(60))
    rows = [(i, f"{body(i)}\n\nRead our newsletter\n\n{body(1000 + i)}" if i % 2 else f"{body(i)}\n\n{body(1000 + i)}", "a") for i in range(400)]
    rows += [(1000 + i, f"Top line\nMenu of all things\nLast of it\n{body(i)}" if i < 200 else body(i), None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.assess(df).select("doc.doc_id", "quality.*").collect()}
    assert all(out[i].lost_words == (3 if i % 2 else 0) and out[i].kept and "newsletter" not in out[i].text for i in range(400))
    assert all(out[1000 + i].lost_words == (9 if i < 200 else 0) and out[1000 + i].kept for i in range(300))


def test_lists_are_broadcast_or_shuffled(spark, docs, monkeypatch):
    df = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 100))
    one = sorted(map(str, quality.assess(df, 2, 0.01).collect()))
    monkeypatch.setattr(quality, "BROADCAST_LINES", -1)
    assert sorted(map(str, quality.assess(df, 2, 0.01).collect())) == one


def test_columns_and_empty(odd, empty):
    assert quality.clean(odd).columns == odd.columns
    assert quality.clean(odd).count() > 0
    assert quality.verdicts(empty).count() == 0
