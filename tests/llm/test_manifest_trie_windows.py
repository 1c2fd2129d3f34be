"""Merkle manifest, conversation trie and repeated windows against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("sparkscreen.llm.queries")
from sparkscreen.llm import merkle, trie, windows  # noqa: E402
from sparkscreen.llm.common import reach_workers  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, grp long, leaf string"
ODD = [
    (1, "one two three four five", "en", "a", 23, 0, "x"),
    (1, "one two three four five", "en", "a", 23, 0, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 1, "y"),
    (None, "no id here, but words", "en", None, 5, 2, "z"),
    (4, "w " * 9000, "en", "a", 18000, 3, ""),
    (5, "ß é 漢字   mixed\r\n\r\n  spaces\tand 'll don't", "de", "b", 0, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    reach_workers(spark)
    return spark.createDataFrame(ODD, COLUMNS)


# ---- 11 ----


def hashed(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, more=0):
    n = d["n_chars"] + more if d["n_chars"] is not None else None
    return hashed("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], n, d["text"]))


def level_up(nodes, fanout):
    return [hashed(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def plain_proofs(docs, fanout=2):
    """One tuple of the contract's values for each document, by trees that are built whole."""
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append((leaf(d), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        trees.append([[x for x, _ in groups[g]]])
    trees.append([None])
    for t, levels in enumerate(trees):
        if levels[0] is None:
            levels[0] = [x[-1][0] for x in trees[:-1]]
        while len(levels[-1]) > 1:
            levels.append(level_up(levels[-1], fanout))
    root, out = trees[-1][-1][0], []
    for t, g in enumerate(order):
        for i, (own, d) in enumerate(groups[g]):
            tampered = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            seen, proof = leaf(d, 1) if tampered else own, []
            for levels, at in ((trees[t], i), (trees[-1], t)):
                for nodes in levels[:-1]:
                    first = at - at % fanout
                    run = nodes[first : first + fanout]
                    proof += run[: at - first] + run[at - first + 1 :]
                    seen = hashed([*run[: at - first], seen, *run[at - first + 1 :]])
                    at //= fanout
            out.append((d["doc_id"], own, trees[t][-1][0], root, hashed(proof), seen, seen == root))
    return out


def leaves_of(docs):
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [c if i != 3 else F.col("n_chars") + 1 for i, c in enumerate(cols)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), F.unhex(merkle.leaf_digest(cols)).alias("leaf"), F.when(hit, F.unhex(merkle.leaf_digest(more))).alias("new"))


PROOF = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("fanout,block_levels,round_levels,sizes", [(2, 1, 1, (1, 2, 3, 11, 37)), (2, 2, 2, (70, 64, 5)), (3, 1, 1, (28, 1, 30))])
def test_butterfly_equals_whole_trees(spark, fanout, block_levels, round_levels, sizes):
    """Blocks of a few leaves, so that there are several rounds and shorter last subtrees."""
    reach_workers(spark)
    rows = [(100 * g + i, f"text {i}", [None, "de", "en", "é", "z"][g], "s", i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.proofs(merkle.manifest(leaves_of(docs), fanout, block_levels, round_levels), fanout, block_levels, "new")
    got = found.select(*PROOF).collect()
    assert in_order(got) == in_order(plain_proofs([r.asDict() for r in docs.collect()], fanout))
    assert not all(r["verified"] for r in got)


def test_proofs_of_odd_rows(spark, odd):
    """Nulls, equal rows and clashing names: leaves like any other. An empty table gives no rows."""
    got = merkle.proofs(merkle.manifest(leaves_of(odd), block_levels=1, round_levels=1), block_levels=1, changed="new").select(*PROOF).collect()
    assert in_order(got) == in_order(plain_proofs([r.asDict() for r in odd.collect()]))
    assert merkle.proofs(merkle.manifest(leaves_of(odd.limit(0)))).collect() == []


def test_a_proof_is_what_a_verifier_needs(spark, odd):
    """Leaf and siblings give the root without the table; any other leaf does not."""
    for r in merkle.proofs(merkle.manifest(leaves_of(odd), block_levels=1, round_levels=1), block_levels=1).collect():
        path = [(x["others"], x["left"]) for x in r["proof"]]
        assert r["verified"] and merkle.fold(bytes.fromhex(r["leaf"]), path).hex() == r["root"] == r["folded_root"]
        assert merkle.fold(b"other", path).hex() != r["root"]


# ---- 12 ----


def plain_trie(rows):
    """rows (conv_id, turn, role, text) -> the contract's rows, from every conversation rebuilt and every prefix counted."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    up = lambda n: members[n[:-1]][0] if n else None
    return [(m[0], len(n), up(n), len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()]


def turns(spark, rows):
    return trie.turn_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def made_conversations(seed, convs, words, longest):
    draw = random.Random(seed)
    return [(c, t, draw.choice(("user", "assistant")), draw.choice(words)) for c in convs for t in range(draw.randint(1, longest))]


@pytest.mark.parametrize("cells,piece,rows", [(4, 1 << 14, made_conversations(1, range(0, 120), ("a", "bé", ""), 9)), (4, 3, made_conversations(2, range(3, 60), ("a",), 14)), (0, 2, made_conversations(3, [7, 12, 13, 14, 35, 36], ("x", "y"), 12))])
def test_trie_equals_plain_one(spark, monkeypatch, cells, piece, rows):
    """Many prefixes shared; long conversations in pieces; heads that are absent. Turns without own part give members of the root."""
    reach_workers(spark)
    monkeypatch.setattr(trie, "CELLS", cells)
    got = trie.trie(*trie.rebuilt_turns(turns(spark, rows)), piece=piece).collect()
    assert in_order(got) == in_order(plain_trie(rows))


def test_trie_of_odd_rows(spark):
    """Null turns come first, null roles and texts are empty, rows of no conversation are left out, conversations without turns are the root's."""
    rows = [(1, None, "user", "first"), (1, 2, None, None), (1, 3, "", ""), (None, 1, "user", "nobody's"), (6, 1, "user", "x" * 100_000), (10, 5, "user", "b"), (10, 2, "user", "a"), (11, 1, "user", "own"), (3, 1, "u", "gone, as h is larger and the head absent")]
    assert in_order(trie.trie(*trie.rebuilt_turns(turns(spark, rows))).collect()) == in_order(plain_trie(rows))
    assert trie.trie(*trie.rebuilt_turns(turns(spark, rows).limit(0))).collect() == []


def test_equal_conversations_end_at_one_node(spark):
    """A node where most conversations end, its ids put together from several batches and ranges; and conversations as they are."""
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(3)] + [(5000, 0, "user", "same 0"), (5000, 1, "user", "other")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = trie.trie(*trie.plain_turns(turns(spark, rows))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {(r["conv_id"], r["depth"]): r for r in got}
    assert len(got) == 5 and by[0, 1]["n_convs"] == 3001 and by[0, 0]["n_children"] == 1 and by[0, 1]["n_children"] == 2
    assert by[0, 3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert by[0, 2]["saved_tokens"] == 2 * 2999 * 6 and by[5000, 2]["parent_conv_id"] == 0


def test_sketch_never_estimates_too_low(spark):
    """A prefix that is screened as one conversation's own is that; few cells make the sketch keep more, not lose any."""
    rows = made_conversations(5, range(400), ("a", "b", "c", "d"), 6)
    prefixes = trie._prefixes(trie.plain_turns(turns(spark, rows))[0], trie.PIECE)
    seen = trie._screened(trie.written(prefixes, "prefixes"), 2000)
    counts = Counter((r["p1"], r["p2"]) for r in seen.collect())
    kinds = [(r["kind"], counts[r["p1"], r["p2"]]) for r in seen.collect()]
    assert all(n == 1 for kind, n in kinds if kind != trie.SHARED) and any(kind != trie.SHARED for kind, _ in kinds)


# ---- 13 ----


def plain_windows(docs, width):
    own = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[p : p + width]) for w in own for p in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, own):
        gone = {p + k for p in range(len(w) - width + 1) if seen[tuple(w[p : p + width])] > 1 for k in range(width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def removed(df, width=windows.WORDS):
    return [tuple(r) for r in windows.repeated_words(df, width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_windows_of_all_documents(docs):
    got = removed(docs)
    assert in_order(got) == in_order(plain_windows([tuple(r) for r in docs.select("doc_id", "text").collect()], 35)) and any(r[2] for r in got)


@pytest.mark.parametrize("width", [2, 3, 5, 8, 35])
def test_windows_of_few_words(spark, monkeypatch, width):
    """Periodic texts, copies, passages of just the width and one word less, within a text and between two; several buckets."""
    reach_workers(spark)
    monkeypatch.setattr(windows, "BUCKET_HASHES", 50)
    draw = random.Random(width)
    some = lambda n: [draw.choice("abcdefgh") for _ in range(n)]
    passage, short = some(width), some(max(1, width - 1))
    texts = ["a " * 200, "a b " * 60, " ".join(some(150)), " ".join(some(30) + passage + some(9)), " ".join(passage + some(40)), " ".join(short + ["x"] + some(5)), " ".join(["y"] + short), " ".join(passage[:-1]), "copy of " + " ".join(some(50))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, texts[-1]), (90, texts[-1]), (91, "a b " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert in_order(removed(df, width)) == in_order(plain_windows(rows, width))


def test_windows_of_odd_rows(spark, odd):
    """Null ids, null and empty texts, a long text of one word, rows that are equal, columns of any name; an empty table."""
    assert in_order(removed(odd, 4)) == in_order(plain_windows([(r[0], r[1]) for r in ODD], 4))
    assert removed(odd.limit(0)) == []
    gone = {r["doc_id"]: [(x["start"], x["end"]) for x in r["gone"]] for r in windows.repeated_words(odd, 4).collect()}
    assert gone[4] == [(0, 9000)] and gone[1] == [(0, 5)] and gone[2] == []


def test_a_hot_passage_and_hot_copies(spark):
    """A third of all rows one text, a third one passage with words of their own around it."""
    reach_workers(spark)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, "too short") for i in range(600)] + [(600 + i, " ".join(f"c{k}" for k in range(50))) for i in range(600)] + [(1200 + i, f"own{i} before{i} {passage} behind{i} own{i}") for i in range(600)]
    got = {r[0]: r for r in removed(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert len(got) == 1800 and all(got[i][2] == 0 for i in range(600)) and all(got[i][2] == 50 for i in range(600, 1200))
    assert all(got[1200 + i][1:] == (44, 40, hashlib.sha256(f"own{i} before{i} behind{i} own{i}".encode()).hexdigest()) for i in range(600))
