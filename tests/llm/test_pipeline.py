import re
from collections import Counter
from itertools import combinations

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_quality import WORD, base

from ticketloom.llm import decontaminate, near_dedup, pii, quality
from ticketloom.llm.common import table


def test_stages_over_the_tables(spark, small):
    """Each stage against the plain decision of its operator on the stage's own input."""
    docs = table(spark, small, "documents")
    columns = docs.columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    seen = []
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, small), cp.scratch_path(spark, name))
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            assert ids(out) == {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
        elif name == "near_dedup":
            assert ids(out) == {r.doc_id for r in near_dedup.classes(docs).where("kept").collect()}
        elif name == "decontamination":
            items = table(spark, small, "benchmark")
            assert ids(out) == ids(docs) - ids(decontaminate.leaks(docs, items))
            text = {r.doc_id: r.text for r in docs.collect()}
            whole = {i for i, t in text.items() for b in items.collect() if b.text in t}
            assert not whole & ids(out)
        elif name == "pii":
            assert ids(out) == ids(docs)
            left = out.join(pii.pii_digest(docs).select("doc_id", F.explode("kinds")), "doc_id").where("text is null").count()
            assert left == 0
        else:
            assert ids(out) == ids(docs)
        docs = out
        seen.append(name)
    assert seen == ["quality", "near_dedup", "decontamination", "pii", "packing"]


def plain_quality(rows):
    """Texts kept, by id: base rules, and lines that many different documents of a host share."""
    norm = lambda x: re.sub("[ \\t\\x0b\\f\\r]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    hosts = {}
    for r in rows:
        hosts.setdefault(r.source, {})[r.text or ""] = {norm(x) for x in (r.text or "").split("\n")} - {""}
    bad = {}
    for host, texts in hosts.items():
        count = Counter(x for lines in texts.values() for x in lines)
        bad[host] = {x for x, n in count.items() if n >= quality.LINE_DOCUMENTS and n >= quality.LINE_SHARE * len(texts)}
    out = {}
    for r in rows:
        lines = (r.text or "").split("\n")
        lost = [x for x in lines if norm(x) in bad[r.source]]
        n = len(WORD.findall(r.text or ""))
        if not base(r.text)[-1] and 2 * len(WORD.findall("\n".join(lost))) <= n:
            out[r.doc_id] = "\n".join(x for x in lines if norm(x) not in bad[r.source]) if lost else r.text
    return out


def plain_classes(rows):
    """Ids kept: the smallest of each group that links of 0.8 over five-word shingles hold together."""
    sets = {}
    for r in rows:
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in sets if find(i) == i}


def test_first_stages_against_plain_versions(spark, small):
    docs = table(spark, small, "documents")
    # a header of one host, in more than twenty different documents
    shared = F.when((F.col("source") == docs.first().source) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("Menu  12 of all\n"), "text"))
    docs = docs.withColumn("text", F.coalesce(shared, F.col("text")))
    kept = cp.written(cp.quality_rules(spark, docs, small), cp.scratch_path(spark, "plain"))
    rows = kept.collect()
    assert {r.doc_id: r.text for r in rows} == plain_quality(docs.collect())
    assert {r.doc_id for r in cp.near_dedup_stage(spark, kept, small).collect()} == plain_classes(rows)


def test_odd_and_empty_documents(spark, small, odd, empty, tmp_path):
    """Nulls, ties, repeated rows, very long texts and clashing names go through all stages; so does no row."""
    folder = str(tmp_path)
    table(spark, small, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in cp.STAGES:
            docs = cp.written(stage(spark, docs, folder), cp.scratch_path(spark, name))
            if name != "packing":
                assert docs.columns == columns
        if docs.count():
            assert {37, 38} & {r.doc_id for r in docs.collect()} == set()
