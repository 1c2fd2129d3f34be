"""The ten operators against brute force, exact round trips or held-out accuracy, on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

llm = pytest.importorskip("sparkscreen.llm.queries")
from sparkscreen.llm import html_text, lines, media, mixing, neardup, packing, sharding, simhash, sketches, token_files, tokens, toxicity  # noqa: E402
from sparkscreen.llm.common import reach_workers, written  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h long, row string"
ODD = [
    (1, "one two three four five", "en", "a", 23, 0, "x"),
    (1, "one two three four five", "en", "a", 23, 0, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 1, "y"),
    (None, "no id here, but words", "en", None, 5, 2, "z"),
    (4, "w " * 9000, "en", "a", 18000, 3, ""),
    (5, "ß é 漢字   mixed\r\n\r\n  spaces\tand <|endoftext|> 'll don't", "de", "b", 0, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    reach_workers(spark)
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def library(name, text):
    from tokenizers import Tokenizer

    if name not in LIBRARY:
        LIBRARY[name] = Tokenizer.from_file(tokens.tokenizer_path(name))
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


LIBRARY = {}


@pytest.mark.parametrize("name", [tokens.WORD_FILE, tokens.BYTE_FILE])
def test_cached_ids_are_the_library_s(name, texts):
    enc = tokens.CachedEncoder(tokens.tokenizer_path(name), cache_bytes=100_000)
    odd = [r[1] or "" for r in ODD] + ["a  b", " a", "a ", "a\tb  c", "a\n\nb", "\x1ca\x1fb", "İI ΑΣ", "x" * 5000, "don't 'S we'LL", "é é", "1234 ½"]
    for t in [*odd, *list(texts.values())[:40]]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library(name, t), t[:50]


@pytest.mark.parametrize("name", [tokens.WORD_FILE, tokens.BYTE_FILE])
def test_ids_of_random_strings_are_the_library_s(name):
    """Parts that have gone wrong, or could, put together at random; the call has no switch but the contract's."""
    draw, enc = random.Random(4), tokens.CachedEncoder(tokens.tokenizer_path(name), cache_bytes=50_000)
    parts = [*"ab1.,!_\t\r\0\x0b\x1c\x85\xa0", *"\n\n\n    ", "Hello", "'s", "23", "é", "ß", "İ", "ſ", "ǅ", "²", "ж", "漢", "e\u0301", "\u2002", "\u3000", "\u200b", "😀", "<|endoftext|>", "<|startoftext|>"]
    for _ in range(5000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == library(name, t), repr(t)


def test_special_tokens_as_text():
    enc = tokens.CachedEncoder(tokens.tokenizer_path(tokens.BYTE_FILE), special_as_text=True)
    assert 50256 not in np.frombuffer(enc.encode("a <|endoftext|>"), "<u4") and 50256 in library(tokens.BYTE_FILE, "a <|endoftext|>")


# ---- 1 ----


def pieces(t):
    return set(re.findall(r"\S+(?:[^\S\n]+\S+){0,%d}" % (sketches.PIECE_WORDS - 1), t))


def held_digests(fingerprint):
    """The digests that a fingerprint's text holds, by peeling its blocks."""
    found, at = set(), 0
    while at < len(fingerprint):
        m = (8, 32, 128)[int(fingerprint[at])]
        raw = [fingerprint[at + 1 + 28 * i :][:28] for i in range(3 * m)]
        cells, at = [[int(x[:4], 16), int(x[4:20], 16)] for x in raw], at + 1 + 84 * m
        own, todo = set(), [y for y in cells if y[0] == 1]
        while todo:
            c, k = todo.pop()
            if c == 1 and k not in own:
                own.add(k)
                for t in range(3):
                    y = cells[t * m + (k >> 7 * t) % m]
                    y[0], y[1] = y[0] - 1, y[1] ^ k
                    todo += [list(y)] if y[0] == 1 else []
        assert not any(c or k for c, k in cells)
        found |= own
    return found


def test_sketches_equal_brute_force(docs, texts):
    """All texts; the likenesses follow from the two fingerprint columns alone."""
    got = {r["doc_id"]: r for r in sketches.compare_versions(docs).collect()}
    ids = sorted(got, reverse=True)
    own = {d: held_digests(r["fingerprint"]) for d, r in got.items()}
    like = lambda x, y: 1.0 if not (x or y) else (len(x) + len(y) - len(x ^ y)) / (len(x) + len(y))
    for i, d in enumerate(ids):
        after = ids[(i + 1) % len(ids)]
        a, b = texts[d], texts[after]
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(pieces(a), pieces(e))), pytest.approx(like(pieces(a), pieces(b))))
        assert {x - (x >> 63 << 64) for x in own[d]} == {xxhash.xxh64_intdigest(p, 42) - (xxhash.xxh64_intdigest(p, 42) >> 63 << 64) for p in pieces(a)}
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(own[d], held_digests(r["edited_fingerprint"]))), pytest.approx(like(own[d], own[after])))


def test_peeling_recovers_digests_and_larger_tables_help(spark):
    a, b = list(range(1, 20)), list(range(11, 60))
    random.seed(1)
    values = [random.getrandbits(63) for _ in range(60)]
    df = spark.createDataFrame([([values[i] for i in a], [values[i] for i in b])], "a array<long>, b array<long>")
    at = lambda c: df.select(sketches.peeled(sketches.subtracted(sketches.sketch(F.col("a"), c), sketches.sketch(F.col("b"), c)), c)).first()[0]
    assert at(8) is None
    assert sorted(at(128)) == sorted(values[i] for i in set(a) ^ set(b))


def test_sketches_of_odd_rows(odd, none):
    rows = sketches.compare_versions(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert sketches.compare_versions(none).count() == 0


# ---- 2 and 6 ----


def check_packing(rows, capacity):
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity


def test_packing(docs, texts):
    rows = packing.pack_documents(docs).collect()
    check_packing(rows, packing.CAPACITY)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in texts.items():
        ids, own = [*library(tokens.WORD_FILE, t), 1], sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), packing.CAPACITY))
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * -(-total // packing.CAPACITY) + 1


def test_packing_in_many_tasks_merges_what_stays_open(spark):
    reach_workers(spark)
    random.seed(2)
    table = written(spark.createDataFrame([(i, random.randint(1, 60)) for i in range(3000)], "id long, length long"), "p")
    rows = packing.best_fit_pack(table, 100, open_bins=8, per_task=200).collect()
    check_packing(rows, 100)
    assert len(rows) == 3000 and len({r["sequence_id"] for r in rows}) <= 1.08 * sum(r["length"] for r in rows) / 100
    with pytest.raises(ValueError):
        packing.best_fit_pack(written(spark.createDataFrame([(101,)], "length long"), "p"), 100)


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the second is the fullest when the third comes
    assert sorted(fit.still_open()) == [(0, 6), (2, 8)]
    assert fit.place(2) == (2, 8) and fit.place(4) == (0, 6)


def test_packing_and_files_of_odd_rows(spark, odd, none, tmp_path):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, packing.CAPACITY)
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 9001
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack_documents(none).count() == 0
    for n, df in enumerate((odd, none)):
        files = token_files.write_token_files(df, f"file://{tmp_path}/{n}", tokens.tokenizer_path(tokens.BYTE_FILE))
        got = token_files.read_token_files(spark, files, keep_ids=True).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in df.collect())


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", tokens.tokenizer_path(tokens.BYTE_FILE))
    at = 0
    for r in sorted(token_files.read_token_files(spark, files, keep_ids=True).collect(), key=lambda r: r["doc_id"]):
        ids = [*library(tokens.BYTE_FILE, texts[r["doc_id"]]), 2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(bytes(r["ids"])))
        at += len(ids)


# ---- 3 and 5 ----


@pytest.mark.parametrize("rows_per_range", [sharding.ROWS_PER_RANGE, 1])
def test_shards(docs, odd, none, monkeypatch, rows_per_range):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", rows_per_range)
    for df in (docs, odd):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count()
        total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        for s in range(sharding.SHARDS):
            own = [r for r in rows if r["shard"] == s]
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / sharding.SHARDS) <= most
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_documents(odd).collect()}
    assert sizes[2] == (16, 0) and sizes[1] == (39, zlib.crc32(ODD[0][1].encode()))
    assert sharding.shard_documents(none).count() == 0


def test_overfull_ranges_are_cut_again(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(6000)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("t"), F.lit(20).alias("size"))
    bounds, stats = sharding.split_ranges(written(keyed, "k"), 60)
    assert sum(n for _, _, n in stats) == 6000 and max(b for _, b, _ in stats) <= 2 * 20 * 6000 / 60 + 20
    assert bounds == sorted(set(bounds))


def test_mix_equals_sql(docs, odd, none):
    con = duckdb.connect()
    for df in (docs, odd):
        con.register("documents", df.select("doc_id", "text", "source").toArrow())
        got = sorted(map(tuple, mixing.mix_documents(df).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
        want = sorted(con.sql(mixing.OP5_SQL).fetchall(), key=str)
        assert [(g[0], g[1], g[2], round(g[3], 6), g[4]) for g in got] == [(w[0], w[1], w[2], round(w[3], 6), w[4]) for w in want]
        assert all(r[4] <= 3 * r[1] for r in got)
    assert mixing.mix_documents(none).count() == 0


def test_mixed_rows_hold_the_words_taken(docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs).collect()}
    rows = {}
    for r in mixing.mixed_rows(docs).collect():
        rows[r["doc_id"]] = rows.get(r["doc_id"], 0) + len(re.findall(mixing.WORD, r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert rows == {d: n for d, n in taken.items() if n}


def test_mixed_rows_of_repeated_rows_and_other_names(odd, spark):
    extra = odd.withColumns({c: F.lit(7) for c in ("k", "z", "taken", "copy", "plan", "size", "_n", "_words")}).drop("n_chars")
    twice = extra.unionByName(extra)
    want = mixing.mix_documents(twice).groupBy("doc_id").agg(F.sum("taken")).filter("sum(taken) > 0").collect()
    got = mixing.mixed_rows(twice)
    assert got.columns == extra.columns and all(r["taken"] == r["k"] == r["_n"] == 7 for r in got.collect())
    assert sorted(map(tuple, got.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text")))).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_inclusion_rates_are_the_probabilities(spark):
    """Sources that hold the same sizes are so many draws."""
    sizes, draws = [1, 2, 2, 3, 5, 8, 13, 20, 20, 40], 900
    rows = [(100 * s + i, "w " * n, f"s{s:04d}") for s in range(draws) for i, n in enumerate(sizes)]
    found = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("more", F.col("taken") - F.col("whole") * F.col("size"))
    rates = found.groupBy("size", "p", (F.substring("source", 2, 4).cast("int") % 3).alias("w"), "whole").agg(F.avg(F.col("more") / F.col("size")).alias("rate"), F.sum("more").alias("words"), F.sum(F.col("p") * F.col("size")).alias("want")).collect()
    assert len({r["w"] for r in rates}) == 3 and any(r["p"] == 1 for r in rates) and any(0 < r["p"] < 0.9 for r in rates)
    for r in rates:
        assert abs(r["rate"] - r["p"]) < 0.09, r
    for w in range(3):
        assert sum(r["words"] for r in rates if r["w"] == w) == pytest.approx(sum(r["want"] for r in rates if r["w"] == w), rel=0.02)


# ---- 4 ----


def brute_components(nodes, linked):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(nodes)), 2):
        if linked(nodes[i], nodes[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def plain_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints_and_components(docs, texts, odd, none):
    fps = {r["doc_id"]: r for r in simhash.near_components(written(simhash.fingerprints(docs), "f")).collect()}
    ids = sorted(texts)
    plain = [plain_simhash(texts[d]) for d in ids]
    assert [fps[d]["fp"] & (1 << 64) - 1 for d in ids] == plain
    roots = brute_components(plain, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [fps[d]["component_id"] for d in ids] == [ids[r] for r in roots]
    got = simhash.near_components(written(simhash.fingerprints(odd), "f")).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (2, 3)} == {2}
    assert simhash.near_components(written(simhash.fingerprints(none), "f")).count() == 0


@pytest.mark.parametrize("crowd", [2, 1000])
def test_crowded_keys_lose_no_link(spark, crowd):
    random.seed(5)
    values = set()
    for base in [random.getrandbits(64) for _ in range(4)]:
        for _ in range(80):
            v = base
            for _ in range(random.randint(0, 5)):
                v ^= 1 << random.randrange(64)
            values.add(v)
    values = sorted(values)
    df = written(spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "doc_id long, fp long"), "f")
    got = [r["component_id"] for r in simhash.near_components(df, crowd=crowd).orderBy("doc_id").collect()]
    assert got == brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)


def test_near_copies_leave_one(docs, texts):
    sets = {d: set(simhash.shingle_hashes(t, neardup.SHINGLE)) for d, t in texts.items()}
    ids = sorted(texts)
    similarity = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    roots = brute_components(ids, lambda a, b: similarity(a, b) >= 0.8)
    kept = {r["doc_id"] for r in neardup.keep_one(docs).collect()}
    groups = {}
    for d, r in zip(ids, roots):
        groups.setdefault(r, []).append(d)
    assert all(sum(d in kept for d in g) <= 1 for g in groups.values())
    gone = [d for d in ids if d not in kept]
    assert all(max(similarity(d, o) for o in ids if o != d) >= 0.8 for d in gone)


# ---- 7 ----


def brute_lines(rows):
    occ, first, keys, drop = [], {}, {}, set()
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            w = tuple(re.sub(r"[ \t\x0b\f\r]+", " ", line).lower().strip(" ").split(" "))
            if w != ("",):
                occ.append((d, p, w))
    for d, p, w in sorted(occ, key=lambda x: x[:2]):
        first.setdefault(w, (d, p))
    near = {w: f for w, f in first.items() if len(w) >= lines.NEAR_WORDS}
    for w, f in near.items():
        for i in range(len(w)):
            keys.setdefault((i, w[:i], w[i + 1 :]), []).append((f, w))
            short = w[:i] + w[i + 1 :]
            if short in near:
                drop.add(w if near[short] < f else short)
    for m in keys.values():
        drop.update(w for _, w in sorted(m)[1:])
    gone = {(d, p) for d, p, w in occ if first[w] != (d, p) or w in drop}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


def test_lines_equal_brute_force(docs, texts, odd, none):
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs.select("doc_id", "text")).collect()}
    assert got == brute_lines(sorted(texts.items()))
    kept = lines.dedup_lines(odd)
    assert kept.count() == len(ODD) and kept.columns == [*odd.columns, "lines_before", "lines_gone"]
    assert lines.dedup_lines(none).count() == 0


def test_lines_one_word_apart(spark):
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(0, base), (1, [*base[:5], "X", *base[6:]]), (2, [*base, "more"]), (3, base[1:]), (4, base[2:]), (5, "a b c d".split()), (6, "A b c d".split()), (7, ["a", "b"]), (8, ["a", "b"]), (9, [*base[:5], "Y", *base[6:], "Z"]), (10, base[:9])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(11, "x " * 40 + "z"), (12, "x " * 41 + "z"), (13, "x " * 41 + "z q\nkeep this line of five")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


# ---- 8, 9, 10 ----


def test_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.fit(pages)
    found = {r["page_id"]: r for r in html_text.extract_text(pages, model).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert found[p["page_id"]]["text"] == "\n\n".join(b for b in parts if b)
        assert found[p["page_id"]]["n_chars"] == len(found[p["page_id"]]["text"])
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b<p>c <div class='x"), (4, "u", "plain " * 50_000)], "page_id long, url string, html string")
    assert html_text.extract_text(odd, model).filter("page_id < 3 and text = ''").count() == 2
    other = "<body><div class='top-menu'><a>Home</a><a>News</a></div><div class='cookie-consent'><p>We use cookies to make this work, and to count.</p></div><div class='story'><h1>A title</h1><p>First words of a story, with more to come. And on.</p><p>Second words, with a stop.</p></div><div class='comments'><p>I do not agree with it, sorry.</p></div><div id='footer'>&copy; Us</div></body>"
    assert html_text.main_text(other, model) == "A title\n\nFirst words of a story, with more to come. And on.\n\nSecond words, with a stop."


#: Never trained on.
OTHER_LAYOUTS = (
    '<html><body><div id="top"><div><a>{s}</a></div><div><a>{s}</a></div></div><section class="story"><h1>{t}</h1><div>{m}</div><div>{m}</div><ul><li>{m}</li></ul></section><div class="comments"><div class="who">{s}</div><div>{o}</div></div><div id="footer">{o}</div></body></html>',
    "<div><h1>{t}</h1><p>{m}</p><p>{m}</p><ol><li>{m}</li><li>{m}</li></ol></div>",
    "<body><nav><a>{s}</a></nav><p>{m}</p><p>{m}</p><footer>{o}</footer></body>",
)


def test_layouts_never_trained_on(docs, spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.fit(pages)
    parsed = [(b, y) for r in pages.limit(60).collect() if (y := html_text.marked_labels(b := html_text.blocks(r["html"]))) is not None]
    for layout in OTHER_LAYOUTS:
        monkeypatch.setattr(html_text, "LAYOUTS", (layout,))
        made = html_text.layout_pages(parsed, 40, seed=9)
        found = [(p, q) for b, y in made for p, q in zip(model.decode(html_text.features(b)), y)]
        assert len(made) == 40 and sum(p and q for p, q in found) >= 0.95 * max(sum(p for p, _ in found), sum(q for _, q in found)), layout
    for page in ("plain words without tags", "<p>a<b>b</b>c … 1 &lt; 2</p>", "<h1>T</h1><p>one two three.</p><ul><li>first item</li><li>second item</li></ul>"):
        assert html_text.main_text(page, model).replace("\n", "") == "".join(b.text for b in html_text.blocks(page))


def test_deeply_nested_pages():
    found = html_text.blocks("<div>x" * 50_000)
    assert len(found) == 50_000 and found[-1].node.inherited is found[0].node.inherited
    assert html_text.features(found)[-1].count("in:div") == 1


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (2, None, "", 5), (None, "v", "<p>Words of it, and more of them.</p>", 5), (3, "w", "<p>" + "word " * 50_000 + "</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    model = html_text.fit(pages)
    got = sorted(map(tuple, html_text.extract_text(pages, model).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", "Words of it, and more of them.", 30), (3, "w", ("word " * 50_000).strip(), 249_999)], key=str)
    assert html_text.extract_text(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_segments_are_all_maximal():
    random.seed(3)
    for _ in range(200):
        scored = [(i, random.choice([-3.0, -1.0, 1.0, 2.0])) for i in range(14) if random.random() < 0.7]
        total, full = dict(scored), []
        value = [total.get(i, -toxicity.DRIFT) for i in range(14)]

        def split(a, b, value=value, full=full):
            best = max(((round(sum(value[i:j]), 9), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                full.append((best[0], best[2], best[3]))
                split(a, best[2])
                split(best[3], b)

        split(0, 14)
        assert sorted((round(s, 9), a, b) for s, a, b in toxicity.maximal_segments(scored)) == sorted(full)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    reach_workers(spark)
    model = toxicity.fit(docs, labels)
    held = labels.filter(toxicity.fold() == 0)
    got = toxicity.score_documents(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").select("score", "toxic").collect()
    hit = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got)
    caught = [r["score"] >= 0.5 for r in got if r["toxic"] == 1]
    assert hit / len(got) > 0.97 and sum(caught) / len(caught) > 0.85
    assert model.score("") < 0.5 and model.score("what a scum, this moron and idiot") > 0.5


def test_toxicity_of_odd_rows(odd, none):
    model = toxicity.Model({"bad$": 5.0}, curve=(-3.0, 1.0, 1.0))
    assert toxicity.score_documents(odd, model).count() == len(ODD)
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    empty = toxicity.fit(odd, none.select("doc_id", F.lit(1).alias("toxic")))
    assert empty.score("bad") < 0.5


def test_media_round_trip(spark, docs, texts, odd, none):
    from sparkscreen.llm.common import scratch_path

    folder = scratch_path(spark, "media")
    assert media.write_media(docs, folder, archive_bytes=50_000) > 3
    stored = {r["doc_id"]: r for r in media.read_media(spark, folder, rangeBytes="20000", batchBytes="4000").collect()}
    assert {d: media.from_wav(bytes(r["media"]))[: r["n_bytes"]].decode() for d, r in stored.items()} == texts
    for df in (odd, none):
        folder = scratch_path(spark, "media")
        media.write_media(df, folder)
        rows = media.media_columns(media.read_media(spark, folder)).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in df.collect())
        assert all(r["payload_bytes"] % media.UNIT == 0 and r["payload_bytes"] > 0 for r in rows)


def test_one_bad_member_is_read_again_by_its_offset(spark, docs, monkeypatch):
    from sparkscreen.llm.common import scratch_path

    folder = scratch_path(spark, "media")
    media.write_media(docs.limit(5), folder)
    reader = media.MediaArchiveReader({"path": folder}, None)
    part = reader.partitions()[0]
    real, failed = media.zlib.decompress, []

    def once(*a):
        if not failed:
            failed.append(1)
            raise media.zlib.error("torn")
        return real(*a)

    monkeypatch.setattr(media.zlib, "decompress", once)
    assert sum(b.num_rows for b in reader.read(part)) > 0 and failed


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    reach_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and docs.count() > 0
        assert name == "mixing" or docs.count() <= before
    rows = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(rows, packing.CAPACITY)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
