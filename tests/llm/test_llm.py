"""Training-data operators against brute force, libraries and round trips, with odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweft.llm import embedding_dedup, fingerprints, language_id, line_dedup, mixing, order_minhash, packing, queries, token_counts, url_rules, warc
from roadweft.llm.hnsw import Index
from roadweft.llm.queries import tokenizer
from roadweft.llm.tokens import Encoder
from roadweft.session import materialize, scratch, table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, digest string, score double"
WORDS = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, ties, repeated rows, a very long text, clashing columns."""
    long = words(30_000, 1)
    base = words(200, 2)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (4, None, None, "b"), (5, "", "fr", "b"), (6, "  \n ", None, None),
        (7, long, "en", "a"), (None, words(50, 3), "fr", "b"), (8, "one two", "fr", "a"), (9, "One  two", "fr", "b"), (10, "123 456", "en", "c"), (11, "é́ <|endoftext|> naïve\tx", "fr", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 3, "x", 0.5) for r in rows], DOCS)
    return materialize(df, "odd"), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_warc_round_trip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").collect()
    found = {r.page_id: r for r in queries.op1_warc_archives(spark, sf_dir).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    assert set(found) == {p.page_id for p in pages}
    for p in pages:
        raw = (p.html or "").encode()
        r = found[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))


def test_warc_odd(spark):
    rows = [(1, "http://a/b c\r\nx", "p"), (2, None, "p"), (2, None, "p"), (3, "u", None), (4, "u", ""), (None, "u", "p"), (None, "v", "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    found = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect()), key=str)
    assert found == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "revisit", 1), (None, "response", None)], key=str)
    assert {r.record_type for r in warc.read(warc.write(df, min_bytes=2)).collect()} == {"response"}
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_archive_has_dictionary():
    records = [warc._record(i, f"http://x/{i}", words(60, i).encode(), None, False) for i in range(100)]
    data = warc.pack_archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    assert list(warc.unpack_archive(data))[1:] == records


def sketch(text):
    return [x for x in re.split(r"[\t-\r ]+", text.lower()) if x]


def test_fingerprints(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in table(spark, sf_dir, "documents").collect()))
    found = {r.doc_id: r for r in queries.op2_document_fingerprints(spark, sf_dir).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [sketch(t)] for i in range(max(1, len(w) - 4))}
    errors = []
    for k, (i, text) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if len(a) > 100:
            errors.append(abs(len(a & b) / len(a | b) - found[i].near_edited))
    assert np.mean(errors) < 0.05
    by_text = defaultdict(set)
    for i, text in docs:
        by_text[text].add(found[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprints_odd(odd, none):
    df, rows = odd
    found = fingerprints.fingerprint_edits(df).collect()
    assert len(found) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert all(r.fingerprint == "" for r in found if r.doc_id in (4, 5, 6)) and all(r.fingerprint for r in found if r.doc_id in (8, 9))
    alone = fingerprints.fingerprint_edits(df.filter("doc_id = 1")).first()
    assert alone.near_next == 1.0
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_merged_sketch(spark):
    a, b = words(400, 5), words(300, 6)
    row = spark.createDataFrame([(a, b)], "a string, b string")
    s = lambda c: fingerprints.sketch_of(F.col(c))
    row = row.select(s("a").alias("a"), s("b").alias("b")).withColumn("m", fingerprints.merge(F.col("a"), F.col("b")))
    assert row.select(fingerprints.containment(F.col("a"), F.col("m"))).first()[0] == 1.0


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


STRANGE = ["", " ", "a  b", "\n\nx y\n", "x\ty", "<|endoftext|> a<|endoftext|>", "it's we'll  O'Re", "É é́ áb", "ΑΣ ΑΣ. İ", "x \n y", "1 22 ٣", "日本 語、テ", "👍🏽 a", "a\x1cb c", "ﬁ x̸ ̸ q", "l'été ha., re?! ÑA. ß µ ª.", "ſ K", "　a b c"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_encoder_is_the_library(spark, sf_dir, name, kind):
    texts = STRANGE + [r.text or "" for r in table(spark, sf_dir, "documents").collect()]
    encoder, truth = Encoder(tokenizer(name), kind), library(name, texts)
    for _ in range(2):  # empty and filled cache
        ids, counts = encoder.ids(pa.array(texts))
        assert counts.tolist() == [len(t) for t in truth] and ids.tolist() == [i for t in truth for i in t]


def test_token_counts(spark, odd, none):
    df, rows = odd
    cache, vocabulary = scratch(spark, "cache"), tokenizer("byte_bpe_50k.json")
    truth = Counter((r[0], len((r[1] or "").encode()), len(t), len(t) > 512) for r, t in zip(rows, library("byte_bpe_50k.json", [r[1] or "" for r in rows])))
    for part in (df.filter("doc_id < 5"), df, df):  # cold, partly warm and warm
        found = Counter(tuple(r) for r in token_counts.count_tokens(part, vocabulary, cache).collect())
        assert found == truth or part is not df and not found - truth
    store = token_counts.TokenCountCache(spark, cache, vocabulary)
    assert spark.read.parquet(store.path).groupBy("digest").count().filter("count > 2").count() == 0
    assert token_counts.count_tokens(none, vocabulary, cache).count() == 0


def check_packing(found, texts):
    truth = library("word_bpe_49k.json", [t or "" for _, t in texts])
    pieces = Counter()
    for (i, _), ids in zip(texts, truth):
        ids = [*ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(r.length for r in found) // 2048)


def test_packing(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    n, least = check_packing(queries.op4_best_fit_packing(spark, sf_dir).collect(), texts)
    assert n <= least * 1.01 + 1


def test_packing_odd_in_small_shards(odd, none):
    df, rows = odd
    check_packing(packing.pack(df, tokenizer("word_bpe_49k.json"), shard_pieces=8).collect(), [r[:2] for r in rows])
    assert packing.pack(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_crossover_keeps_all_pieces():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 2049) for _ in range(300)]
    a, b = (packing.best_fit(rng.sample(range(300), 300), sizes, 2048) for _ in range(2))
    members = [packing.Member(p, "start", 0) for p in (a, b)]
    for child in (packing.crossover(a, b, sizes, 2048, rng), packing.mutate(a, sizes, 2048, rng), packing.evolve(sizes, 2048, 1, members).packing):
        assert sorted(i for s in child for i in s) == list(range(300)) and max(sum(sizes[i] for i in s) for s in child) <= 2048
    assert len(packing.evolve(sizes, 2048, 1, members).packing) <= min(len(a), len(b))


def brute_groups(texts, threshold=0.8):
    """Smallest id of the group by a full alignment (dynamic programme) of all pairs."""

    def labelled(t):
        w = sketch(t or "")
        seen, out = Counter(), []
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    seqs = [labelled(t) for _, t in texts]
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(seqs)):
        for j in range(i):
            a, b = seqs[i], seqs[j]
            if not a or not b or len(set(a) & set(b)) / len(set(a) | set(b)) < threshold:
                continue
            row = [0] * (len(b) + 1)
            for x in a:
                diagonal = 0
                for k, y in enumerate(b, 1):
                    diagonal, row[k] = row[k], diagonal + 1 if x == y else max(row[k], row[k - 1])
            if row[-1] / (len(a) + len(b) - row[-1]) >= threshold:
                part[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_order_minhash_is_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    rng = random.Random(9)
    base = docs[3][1].split()
    for k in range(12):  # edits of many sizes
        changed = [w if rng.random() > k / 100 else w + "x" for w in base]
        docs.append((1000 + k, " ".join(changed)))
    docs.append((2000, " ".join(base[len(base) // 2 :] + base[: len(base) // 2])))  # same shingles, other order
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [found[i] for i, _ in docs] == [docs[g][0] for g in brute_groups(docs)]


def test_order_minhash_blocks(spark):
    base = words(120, 11).split()
    docs = [(i, " ".join(w if random.Random(i * 1000 + k).random() > 0.02 else "new" for k, w in enumerate(base))) for i in range(60)]
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), block=7).collect()}
    assert [found[i] for i, _ in docs] == [docs[g][0] for g in brute_groups(docs)]


def test_order_minhash_odd(odd, none):
    df, rows = odd
    found = order_minhash.near_duplicates(df).collect()
    classes = Counter((r.doc_id, r.class_id, r.kept) for r in found)
    assert classes[2, 1, False] == 2 and classes[3, 1, False] == 1 and classes[1, 1, True] == 1
    assert all(classes[i, i, True] for i in (4, 5, 6, 7, 8, 10, 11)) and classes[9, 8, False] == 1
    kept = order_minhash.remove(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in found if r.kept)
    assert order_minhash.near_duplicates(none).count() == 0 and order_minhash.remove(none).count() == 0


def test_language_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    found = queries.op6_language_id(spark, sf_dir).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_odd(odd, none):
    df, _ = odd
    found = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (4, 5, 6, 10))
    assert all(found[i].lang_pred in ("en", "fr") and 0 <= found[i].score <= 1 for i in (1, 7, 8))
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(none).count() == 0


def test_codewords_differ():
    for n in (2, 4, 5, 9, 40):
        code = language_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all()


def test_embeddings_odd(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    vectors += [(100 + i, [float(x) for x in base[i % 5] + 0.02 * rng.normal(size=8)]) for i in range(60)]
    vectors += [(200, vectors[0][1]), (200, vectors[0][1])]
    strange = [(300, None), (301, []), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7), (306, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + strange, "vec_id bigint, embedding array<double>").withColumn("uid", F.lit(1))
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
    truth = Counter((vectors[i][0], int(link[i].sum()), vectors[label[i]][0], vectors[label[i]][0] == vectors[i][0]) for i in range(len(x)))
    truth += Counter((i, 0, i, True) for i, _ in strange)
    assert Counter(tuple(r) for r in embedding_dedup.near_duplicates(df).collect()) == truth
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def linked(x, queries, own):
    found = embedding_dedup.Linked(Index.build(x.astype(np.float32)), x, np.ones(len(x), np.int64), queries, own, 0.95)
    return found, found.search()


def test_graph_recall():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 32))
    x = np.repeat(centres, 5, 0) + 0.1 * rng.normal(size=(1500, 32))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    found, (audited, recall, _) = linked(x, x[:400], np.arange(400))
    want = (x[:400] @ x.T >= 0.95).sum(1) - 1
    assert audited > 200 and recall >= 0.98 and found.total.sum() >= 0.98 * want.sum() and (found.total <= want).all()


def test_hot_group_of_vectors_is_counted_whole():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=16) + 0.01 * rng.normal(size=(3000, 16)), rng.normal(size=(500, 16))])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    found, _ = linked(x, x, np.arange(len(x)))
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert (found.total == want).all() and (found.label[:3000] == 0).all()


def test_embedding_query_is_brute_force(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    x = np.array([r.embedding for r in rows], float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    links = {r.vec_id: int(n) - 1 for r, n in zip(rows, (x @ x.T >= 0.95).sum(1))}
    assert {r.vec_id: r.n_links for r in queries.op7_embedding_dedup(spark, sf_dir).collect()} == links


def brute_targets(sizes):
    """Water poured by weight in small drops into glasses of twice a source's size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high, total = 0.0, 2.0 * sum(sizes.values()), 1.5 * sum(sizes.values())
    for _ in range(200):  # the level per weight at which all is poured
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * sizes[s]) for s in order) < total else (low, level)
    return {s: min(level * weight[s], 2.0 * sizes[s]) for s in order}


def test_mixing(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    found = queries.op8_mix_sources(spark, sf_dir).collect()
    sizes, taken = Counter(), Counter()
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    due = brute_targets(sizes)
    assert due == pytest.approx(mixing.targets(sizes)) and sum(due.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in found:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(due[r.source]))
    longest = max(r.size for r in found)
    assert all(abs(taken[s] - due[s]) <= longest / 2 for s in due)
    again = queries.op8_mix_sources(spark, sf_dir).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_mixing_narrows_to_the_same(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.lit(None).cast("string"))
    plain, narrowed = (sorted(map(str, mixing.choose(docs, share=0.4, **o).collect())) for o in ({}, {"buckets": 4, "sort_rows": 3}))
    assert plain == narrowed


def test_mixing_odd(odd, none):
    df, rows = odd
    found = mixing.choose(df).collect()
    assert len(found) == len(rows) and all(r.size == 0 for r in found if r.doc_id in (4, 5, 6))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    copies = Counter({i: 0 for i in range(1, 12)})
    for r in found:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.choose(none).count() == 0 and mixing.mix(none).count() == 0


def listed(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_url_rules(spark, sf_dir):
    pages = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    for r in queries.op9_url_filter(spark, sf_dir).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        assert (r.host, r.path) == (host, path)
        rule = listed(host, path)
        assert r.rule == (rule and rule[0]) and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == rule[1]


def test_url_mining(spark):
    labels = [(f"http://x.bad.com/ads/{i}", "block") for i in range(30)] + [(f"http://x.bad.com/news/{i}", "allow") for i in range(30)] + [(f"http://y.good.org/ads/{i}", "allow") for i in range(30)]
    pages = [(1, "http://z.bad.com/ads/9"), (2, "http://z.bad.com/news/9"), (3, "https://q.good.org/ads"), (4, None), (5, "no scheme"), (6, "http://Z.BAD.com/ads/9#f"), (6, "http://Z.BAD.com/ads/9#f"), (None, "http://z.bad.com/ads/1")]
    df = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    found = url_rules.judge(df, [], spark.createDataFrame(labels, "url string, label string"), min_support=0.05).collect()
    assert Counter((r.page_id, r.verdict) for r in found) == Counter([(1, "block"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "block"), (6, "block"), (None, "block")])
    assert url_rules.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_line_dedup_is_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    truth = con.execute(queries.ORACLE_SQL["op10_line_dedup"]).fetchall()
    found = queries.op10_line_dedup(spark, sf_dir).select("doc_id", "source", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(truth, key=repr)


def test_line_dedup_odd(spark, none):
    rows = [(i, f"menu\nline {i}\n\nmenu", None) for i in range(8)] + [(10, None, "a"), (11, "", "a"), (12, "menu", "a")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("n_lines", F.lit("clash"))
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df).collect()}
    assert found[3] == ("line 3\n", 4, 2) and found[10] == (None, 0, 0) and found[11] == ("", 1, 0) and found[12] == ("menu", 1, 0)
    assert line_dedup.drop_boilerplate(none).count() == 0


def test_line_dedup_ratio(spark):
    rows = [(i, ("header\n" if i < 8 else "") + ("copied\n" if i >= 95 else "") + f"line {i}", "a") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()}
    assert found[3] == "line 3" and found[97] == "copied\nline 97"


def test_pipeline(spark, sf_dir, odd, none):
    import corpus_pipeline as pipeline

    docs = table(spark, sf_dir, "documents")
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), "stage")
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert out.agg(F.sum("length")).first()[0] > 0
    for docs in (odd[0], none):
        for _, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "stage")


CLASH = ("score", "n_lines", "n_dropped", "_id", "_k", "_host", "_letters", "a.b", "row", "guess", "digest", "copies", "held_out", "lang_pred", "key", "norm", "_key", "of", "lines")


@pytest.fixture(scope="module")
def clashing(spark, sf_dir):
    """Documents with columns of the names that operators use inside; each holds what tells its row."""
    docs = table(spark, sf_dir, "documents")
    more = [F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASH]
    return materialize(docs.select("*", *more), "clashing")


def test_stages_keep_clashing_columns(spark, sf_dir, clashing):
    import corpus_pipeline as pipeline

    docs = clashing
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), "stage")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASH), name
        docs = out


def test_operators_keep_clashing_columns(clashing):
    for out, new in (
        (line_dedup.drop_boilerplate(clashing), {"n_lines", "n_dropped"}),
        (language_id.identify(clashing), {"held_out", "lang_pred", "score"}),
        (order_minhash.remove(clashing), set()),
        (mixing.mix(clashing), set()),
        (fingerprints.with_sketch(clashing, "text", "sketch"), set()),
    ):
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASH if c not in new)
    for out in (warc.read(warc.write(clashing.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[f"`{c}`" for c in CLASH]))), packing.pack(clashing, tokenizer("word_bpe_49k.json")), mixing.choose(clashing), order_minhash.near_duplicates(clashing), fingerprints.fingerprint_edits(clashing)):
        assert out.count()


def test_large_and_few_records_get_a_dictionary():
    for records in ([b"x" * 9], [words(150_000, i).encode() for i in range(8)], [b"a" * 3_000_000] * 2):
        whole = [warc._record(i, "http://x", r, None, False) for i, r in enumerate(records)]
        data = warc.pack_archive(whole)
        assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC and list(warc.unpack_archive(data))[1:] == whole
        pieces = warc.samples_of(whole)
        assert len(pieces) >= 40 and sum(map(len, pieces)) <= 2 * warc.SAMPLE_BYTES


def test_warc_of_long_pages_in_a_folder(spark):
    rows = [(i, f"http://h/{i}", words(40_000, i % 3)) for i in range(6)]
    folder = scratch(spark, "archives")
    archives = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), archive_bytes=400_000, folder=folder)
    assert all(r.path.startswith(folder) for r in archives.collect()) and archives.count() >= 2
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read(archives).collect()} == {(i, "response", None) if i < 3 else (i, "revisit", i - 3) for i in range(6)}


def test_next_rows_of_hot_and_null_ids(spark):
    """Every row is followed by the next in (id, hash of text), also where one id has most rows."""
    rng = random.Random(8)
    rows = [(None if k % 5 == 0 else 7 if k % 5 < 4 else rng.randrange(100), f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)).repartition(7)
    found = {r.text: r._next_text for r in fingerprints.with_next(df, "id", "text", ["text"]).collect()}
    order = [r.text for r in df.orderBy(F.col("id").asc_nulls_first(), "h").collect()]
    assert found == dict(zip(order, [*order[1:], order[0]]))


def test_second_run_encodes_only_misses(spark, sf_dir, monkeypatch):
    docs, cache, vocabulary = table(spark, sf_dir, "documents"), scratch(spark, "cache"), tokenizer("byte_bpe_50k.json")
    encoded = []
    real = token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda texts, t: encoded.append(texts.select("digest").distinct().count()) or real(texts, t))
    once = token_counts.count_tokens(docs.filter("doc_id % 2 = 0"), vocabulary, cache).count()
    token_counts.count_tokens(docs, vocabulary, cache).count()
    again = token_counts.count_tokens(docs, vocabulary, cache).collect()
    distinct = docs.select("text").na.fill("").distinct().count()
    assert once and len(encoded) == 2 and sum(encoded) == distinct and len(again) == docs.count()
    assert token_counts.TokenCountCache(spark, cache, vocabulary).read().count() == distinct


def test_token_query_through_lasting_and_own_caches(spark, sf_dir, monkeypatch):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    truth = {i: len(t) for i, t in zip(docs, library("byte_bpe_50k.json", list(docs.values())))}
    encoded, real = [], token_counts.encode_counts
    monkeypatch.setattr(token_counts, "encode_counts", lambda texts, t: encoded.append(texts.select("digest").distinct().count()) or real(texts, t))
    counted = lambda: {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, sf_dir).collect()}
    assert counted() == truth and len(encoded) == 2 and sum(encoded) == len(set(docs.values())) and encoded[0] > 0
    spark.conf.set(queries.TOKEN_COUNTS, scratch(spark, "lasting"))
    try:
        encoded.clear()
        assert counted() == truth and counted() == truth and encoded == [len(set(docs.values()))]
    finally:
        spark.conf.unset(queries.TOKEN_COUNTS)


def test_hot_digest_is_counted(spark):
    rows = [(k, "one text that many share" if k % 3 else f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, tokenizer("byte_bpe_50k.json"), scratch(spark, "cache")).collect()}
    assert [found[k] for k, _ in rows] == [len(t) for t in library("byte_bpe_50k.json", [t for _, t in rows])]


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = [(k, "the one text of which there are copies", "en") for k in range(20_000)] + [(50_000 + k, words(20, k), "en") for k in range(400)] + [(90_000, "un seul texte", "fr")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    languages, drawn = language_id.drawn_texts(df, "text", "lang", 100, 3)
    per = Counter(languages[r.k] for r in drawn.collect())
    assert languages == ["en", "fr"] and per["en"] == 100 and per["fr"] == 1
    assert drawn.select("k", "text").distinct().count() == drawn.count()


def test_codeword_decoding_is_brute_force(spark, sf_dir):
    """Losses bit by bit and word by word, from the trigrams' odds."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    texts = [r.text for r in docs.limit(40).collect()]
    at, score, _, share = model.predict(texts)
    for k, text in enumerate(texts):
        keys, _ = language_id.grams([text])
        margin = [sum(float(model.odds[g, b]) for g in keys) / len(keys) for b in range(model.code.shape[1])]
        losses = [sum(w * np.log1p(np.exp(-language_id.SCALE * m * c)) for w, m, c in zip(model.weights, margin, word)) for word in model.code]
        assert at[k] == int(np.argmin(losses)) and share[k] == pytest.approx(min(losses) / sum(model.weights) / np.log(2), rel=1e-4)
        assert score[k] == pytest.approx(1 / sum(np.exp(min(losses) - x) for x in losses), rel=1e-3)


def test_strange_texts_are_flagged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(-1, "日本語のテキスト 漢字"), (-2, "привет мир снова")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in language_id.identify(docs.unionByName(odd, allowMissingColumns=True)).collect()}
    assert found[-1].strange and found[-2].strange and not any(r.strange for i, r in found.items() if i >= 0)


def test_large_buckets_are_divided(spark):
    base, other = words(120, 11).split(), words(120, 12).split()
    docs = [(i, " ".join(w if random.Random(i * 1000 + k).random() > 0.02 else "new" for k, w in enumerate(base if i % 2 else other))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df, block=4, divide=1).collect()}
    assert [found[i] for i, _ in docs] == [docs[g][0] for g in brute_groups(docs)]


def test_repeated_rows_leave_one(spark):
    rows = [(None, "", "x")] * 40 + [(5, words(30, 1), "x")] * 40 + [(6, words(30, 2), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _k string")
    assert Counter(r.doc_id for r in order_minhash.remove(df).collect()) == {None: 40, 5: 1, 6: 1}


def test_islands_evolve_from_random_orders():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 2049) for _ in range(600)]
    start = packing.evolve(sizes, 2048, 3, generations=0)
    later = packing.evolve(sizes, 2048, 3, generations=packing.GENERATIONS)
    assert start.by == "start" and later.by != "start" and later.generation > 0
    assert len(later.packing) < len(start.packing)


def test_packing_reports_what_found_it(spark, sf_dir):
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), shard_pieces=100).collect()
    assert {r.found_by for r in found} <= {"full", "start", "crossover", "mutation"} and {"crossover", "mutation"} & {r.found_by for r in found}
    assert all((r.found_by == "full") == (r.length == 2048) for r in found)


def brute_rules(rows, support, confidence):
    """Minimal rules by counting every combination of tokens."""
    from itertools import combinations

    n, seen, with_label = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), size):
                seen[part] += 1
                with_label[part, label] += 1
    good = {(p, label) for (p, label), c in with_label.items() if c >= support * n and c / seen[p] >= confidence}
    return {(p, label) for p, label in good if not any(q != p and label == other and set(q) < set(p) for q, other in good)}


def test_mining_is_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        tokens = {rng.choice(["a1", "a2", "a3"]), rng.choice(["b1", "b2"]), rng.choice(["c1", "c2", "c3", "c4"])}
        rows.append((sorted(tokens), "block" if "a1" in tokens and ("b1" in tokens or "c2" in tokens) or rng.random() < 0.03 else "allow"))
    found, _ = url_rules.mine(spark.createDataFrame(rows, "_tokens array<string>, _label string"), 0.02, 0.9)
    assert {(tuple(r.tokens), r.label) for r in found.collect()} == brute_rules(rows, 0.02, 0.9)


def test_tokens_that_always_meet_are_one(spark):
    """A path of twenty common segments would have a million frequent combinations."""
    long = "/".join(f"s{'abcdefghijklmnopqrst'[k]}" for k in range(20))
    labels = [(f"http://bad.com/{long}/{k}", "block") for k in range(40)] + [(f"http://good.com/x/{k}", "allow") for k in range(40)]
    pages = [(1, f"http://bad.com/{long}/99"), (2, "http://good.com/x/99"), (3, "http://deep.a.b.c.d.bad.com/" + "x/" * 3000)]
    found = url_rules.judge(spark.createDataFrame(pages, "page_id bigint, url string"), [], spark.createDataFrame(labels, "url string, label string"), min_support=0.1)
    assert {r.page_id: r.verdict for r in found.collect()} == {1: "block", 2: "allow", 3: "block"}


def test_mined_rules_decide_and_agree_with_held_out_verdicts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = queries.op9_url_filter(spark, sf_dir).collect()
    assert any(r.rule is None and r.mined_rule for r in found) and all(r.mined_rule is None for r in found if r.rule)
    # the method alone, on the covered URLs that it didn't learn from
    by = url_rules.listed(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")), queries.URL_RULES)
    covered = pages.withColumn("action", by["action"]).filter("action IS NOT NULL").withColumn("held", F.crc32(F.col("url").cast("binary")) % url_rules.FOLDS == url_rules.HELD_OUT)
    alone = url_rules.judge(covered.filter("held"), [], covered.filter("NOT held").select("url", F.col("action").alias("label")))
    truth = {r.page_id: r.action for r in covered.collect()}
    assert np.mean([r.verdict == truth[r.page_id] for r in alone.collect()]) > 0.8


def test_sampling_follows_the_weights(spark):
    """Of two equal halves, one of weight 4, Efraimidis-Spirakis keys computed here choose the same."""
    docs = [(k, " ".join(["w"] * 10) + f" {k}", "s") for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([(k, 4.0) for k in range(2000)] + [(k, 0.0) for k in range(2000, 4000, 2)], "doc_id bigint, weight double")
    found = mixing.choose(df, weights, share=0.25).collect()
    taken = {r.doc_id for r in found if r.copies}
    digest = {r.doc_id: r.digest for r in found}
    key = {k: -np.log(((digest[k] % (1 << 64) >> 11) + 1) / (1 << 53)) / (4.0 if k < 2000 else 1.0) for k, _, _ in docs}
    order = sorted(key, key=key.get)
    assert taken == set(order[: len(taken)]) and abs(len(taken) - 1000) <= 1
    assert 0.6 < sum(k < 2000 for k in taken) / len(taken) < 0.85


def brute_lines(docs):
    """(text) of each document without lines on over MAX_RATIO of its source's pages, and MIN_PAGES."""
    pages, seen = Counter(), Counter()
    for _, text, source in docs:
        pages[source] += 1
        for line in {x for x in (text or "").split("\n") if x.strip(" ")} if text is not None else ():
            seen[source, line] += 1
    bad = {k for k, c in seen.items() if c >= line_dedup.MIN_PAGES and c > pages[k[0]] * line_dedup.MAX_RATIO}
    return {i: None if text is None else "\n".join(x for x in text.split("\n") if not x.strip(" ") or (source, x) not in bad) for i, text, source in docs}


def test_pipeline_is_brute_force(spark, sf_dir):
    import corpus_pipeline as pipeline

    stages = dict(pipeline.STAGES)
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    known = materialize(stages["language_id"](spark, docs, sf_dir), "stage")
    kept = {r.doc_id: r for r in known.collect()}
    assert set(kept) == {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")} and all(kept[i].text == rows[i].text and kept[i].lang for i in kept)
    clean = materialize(stages["line_dedup"](spark, known, sf_dir), "stage")
    truth = brute_lines([(i, r.text, r.source) for i, r in kept.items()])
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {i: (t, len(t)) for i, t in truth.items()}
    single = materialize(stages["minhash_near_dedup"](spark, clean, sf_dir), "stage")
    texts = sorted(truth.items())
    groups = brute_groups(texts)
    assert sorted(r.doc_id for r in single.collect()) == [texts[k][0] for k in sorted(set(groups))]
    mixed = materialize(stages["source_mixing"](spark, single, sf_dir), "stage")
    size = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in single.collect()}
    sizes, taken, times = Counter(), Counter(), Counter(r.doc_id for r in mixed.collect())
    for i, (source, n) in size.items():
        sizes[source] += n
        taken[source] += n * times[i]
    due = brute_targets(sizes)
    assert max(times.values()) <= 2 and set(times) <= set(size) and all(abs(taken[s] - due[s]) <= max(n for _, n in size.values()) / 2 for s in due)
    packed = materialize(stages["best_fit_packing"](spark, mixed, sf_dir), "stage")
    n, least = check_packing(packed.collect(), [(i, truth[i]) for i, k in times.items() for _ in range(k)])
    assert n <= least * 1.01 + 1
    whole = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pipeline.run(spark, sf_dir).collect())
    assert whole == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect())


def test_line_dedup_of_long_texts_and_ties(spark):
    long = "\n".join(f"line {k}" for k in range(30_000))
    rows = [(k, ("tie\n" if k < 6 else "") + ("over\n" if k < 7 else "") + f"own {k}", "h") for k in range(99)] + [(99, long + "\nover", "h")]
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert found[3].text == "tie\nown 3"  # on exactly the ratio it stays
    assert found[99].text == long and (found[99].n_lines, found[99].n_dropped) == (30_001, 1)


def test_mined_rules_that_tie(spark):
    """Two rules of equal confidence and support, one for each label: the smaller id decides."""
    labels = [(f"http://a.org/left/{k}", "block") for k in range(30)] + [(f"http://a.org/right/{k}", "allow") for k in range(30)]
    pages = [(1, "http://a.org/left/right/1"), (2, "http://a.org/x?left"), (3, "http://a.org/left/1"), (3, "http://a.org/left/1")]
    one, again = (url_rules.judge(spark.createDataFrame(pages, "page_id bigint, url string"), [], spark.createDataFrame(labels, "url string, label string"), min_support=0.1).collect() for _ in range(2))
    assert Counter((r.page_id, r.verdict) for r in one) == Counter((r.page_id, r.verdict) for r in again)
    assert Counter(r.verdict for r in one if r.page_id == 3) == {"block": 2}
