"""The whole pipeline against a plain version of its five stages."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("sparkscreen.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from sparkscreen.llm import mixing, neardup, packing, simhash, tokens, toxicity  # noqa: E402
from sparkscreen.llm.common import reach_workers  # noqa: E402

from test_operators import brute_components, brute_lines, check_packing, library  # noqa: E402


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """The documents, exact copies, copies whose lines are broken anew and three words longer, and toxic ones with labels."""
    reach_workers(spark)
    at = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    again = lambda plus, text: docs.withColumns({"doc_id": F.col("doc_id") + plus, "text": text})
    exact = again(1_000_000, F.col("text")).filter("doc_id % 3 = 0")
    broken = again(2_000_000, F.concat(F.regexp_replace("text", r"\s*\n\s*", " "), F.lit(" and three more"))).filter("doc_id % 4 = 0")
    insult = " ".join(f"grolk{i} znarf vemp{i % 3} drubble" for i in range(12))
    toxic = again(3_000_000, F.concat("text", F.lit(" " + insult))).filter("doc_id % 4 = 1 AND n_chars > 400")
    docs.unionByName(toxic).unionByName(exact).unionByName(broken).write.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = toxic.select("doc_id", F.lit(0).alias("quality"), F.lit(1).alias("toxic")).select(*[F.col(f.name).cast(f.dataType) for f in labels.schema])
    labels.unionByName(marked).write.parquet(f"{at}/labels.parquet")
    return at


def plain_near_copies(texts):
    """Documents that stay: the least of each group connected by shingle sets of similarity 0.8."""
    sets, ids = {d: set(simhash.shingle_hashes(t, neardup.SHINGLE)) for d, t in texts.items()}, sorted(texts)

    def linked(a, b):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
            return False
        both = len(x & y)
        return x == y or both / (len(x) + len(y) - both) >= 0.8

    roots = brute_components(ids, linked)
    return {d: texts[d] for i, d in enumerate(ids) if roots[i] == i}


def plain_mix(texts, sources):
    """(doc_id, text) of each copy."""
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(texts), "text": list(texts.values()), "source": [sources[d] for d in texts]}))
    found = con.sql(mixing.OP5_SQL)
    for r in (dict(zip(found.columns, r)) for r in found.fetchall()):
        t, left = texts[r["doc_id"]], r["taken"]
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        while left > 0:
            yield r["doc_id"], t if left >= len(ends) else t[: ends[left - 1]]
            left -= len(ends)


def test_run_equals_a_plain_version(spark, planted):
    import corpus_pipeline as cp

    docs, labels = (spark.read.parquet(f"{planted}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.select("doc_id", "text", "source").collect()
    sources = {r["doc_id"]: r["source"] for r in rows}
    model = toxicity.fit(docs, labels)
    clean = {r["doc_id"]: r["text"] or "" for r in rows if model.score(r["text"] or "") < 0.5}
    lined = {d: t for d, t in brute_lines(sorted(clean.items())).items() if t == clean[d] or t.strip(" ")}
    alone = plain_near_copies(lined)
    assert len(rows) > len(clean) > len(lined) > len(alone) > 0
    want = collections.Counter()
    for d, t in plain_mix(alone, sources):
        ids = [*library(tokens.WORD_FILE, t), 1]
        for n, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            piece = ids[at : at + packing.CAPACITY]
            want[d, n, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    got = cp.run(spark, planted).collect()
    check_packing(got, packing.CAPACITY)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) <= 1.03 * -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1
