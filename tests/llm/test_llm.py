import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import audio, bpe, chat, chosen_path, html, kdtree, langid, mixing, pstable, quality, queries
from kmerloom.llm.common import crc_mod, shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, draw int, score double"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["a"] * len(texts))[i], 0, 1, 0.5) for i, t in enumerate(texts)], DOCS)


EDGE = [None, "", "  ", "one", "a b c d e f g", "a b c d e f g", "wörd " * 3000, "x" * 70_000]


# Media


def test_audio_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 575, 576, 577, 5000):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        media = audio.encode(audio.padded(data), n)
        s = audio.parse(media)
        assert audio.read_payload(media, s)[:n] == data and s.tags["TXXX:length"] == str(n)
        assert s.broken == 0 and s.checked == len(s.offsets) == max(1, -(-n // 576)) == s.table["frames"]
        assert s.duration == audio.Fraction(1152 * len(s.offsets), 48000)


def test_audio_damage():
    payload = audio.padded(bytes(range(256)) * 20)
    media = bytearray(audio.encode(payload, 5120))
    s = audio.parse(bytes(media))
    noisy = bytes(media[: s.offsets[2]]) + b"\xff\xfbjunk\xff" + bytes(media[s.offsets[2] :]) + b"TAG" + b"song".ljust(125, b"\0")
    t = audio.parse(noisy)
    assert len(t.offsets) == len(s.offsets) and t.skipped == 7 and t.tags["id3v1:title"] == "song"
    media[s.offsets[1] + 7] ^= 1
    assert audio.parse(bytes(media)).broken == 1
    assert audio.parse(b"").offsets == [] and audio.parse(b"\xff" * 1000).offsets == []
    assert s.seconds[0] == s.offsets[0]


def test_audio_payload_like_tags():
    """Payloads whose last bytes look like trailing tags come back whole, with and without real tags after them."""
    ape = lambda size, flags=0: b"APETAGEX" + b"".join(n.to_bytes(4, "little") for n in (2000, size, 0, flags)) + bytes(8)
    real = b"TAG" + b"song".ljust(125, b"\0")
    texts = [b"x" * (n - 128) + b"TAG" + b"y" * 125 for n in (128, 576, 1152, 5760)]
    texts += [b"x" * n + b"TAG" + b"y" * t for n, t in ((1024, 3), (448, 100), (3000 - 96, 40))]
    texts += [b"x" * (n - 32) + b"APETAGEX" + b" is what a tag of APE holds " [:24] for n in (576, 1152, 5760)]
    texts += [b"x" * (n - 32) + ape(size, flags) for n in (576, 5760) for size in (32, 600, 672, 1344, 3000, 10**6) for flags in (0, 1 << 31)]
    for text in texts:
        payload = audio.padded(text)
        media = audio.encode(payload, len(text))
        for more, tags in ((b"", 1), (real, 6), (ape(32), 1), (ape(32) + real, 6)):
            s = audio.parse(media + more)
            assert audio.read_payload(media + more, s) == payload and s.skipped == 0 and len(s.tags) == tags
    cut = audio.parse(media[:-100] + real)
    assert len(cut.offsets) == len(payload) // 576 - 1 and cut.tags["id3v1:title"] == "song" and cut.skipped == 572


def test_audio_columns(spark):
    df = frame(spark, EDGE)
    got = {r["doc_id"]: r for r in audio.payload_digests(audio.store_texts(df)).collect()}
    for i, t in enumerate(EDGE):
        data = audio.padded((t or "").encode())
        assert got[i]["payload_sha256"] == hashlib.sha256(data).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(data[-32:])
    assert audio.describe(audio.store_texts(df), "doc_id", "media").where("broken = 0 and frames > 0").count() == len(EDGE)
    assert audio.payload_digests(audio.store_texts(df.limit(0))).collect() == []


# Near-duplicates


def brute_links(texts):
    sets = [set(shingles(t).tolist()) for t in texts]
    n = len(sets)
    links = {i: {j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(n)}
    return links, reach(links)


def reach(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = i
                    stack += links[x]
    return out


def test_jaccard_join(spark):
    rng = random.Random(3)
    texts = list(EDGE)
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 40, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([1, 8])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in chosen_path.jaccard_join(frame(spark, texts)).collect()}
    links, comp = brute_links(texts)
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    kept = chosen_path.keep_one(frame(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(comp.values()))


def test_jaccard_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "q r s t u v"), (5, "other words are in this one")], "doc_id long, text string")
    got = chosen_path.jaccard_join(df).collect()
    assert len(got) == 5 and sorted(r["n_links"] for r in got) == [0, 0, 2, 2, 2]
    assert chosen_path.jaccard_join(df.limit(0)).collect() == []


def test_needed_runs():
    """The chance of a shared path against simulated branching with a mean of one child."""
    rng = np.random.default_rng(1)
    alive = np.ones(40_000, int)
    for _ in range(3):
        alive = rng.poisson(alive)
    assert abs((alive > 0).mean() - chosen_path.survival(3)) < 0.01
    assert 1 - (1 - chosen_path.survival(3)) ** chosen_path.needed_runs(0.995) >= 0.995


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.1, 0.25, 0.45)])
    rows = [x.tolist() for x in np.concatenate([base, near, base[:5] * 3])]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 2.0], rows[0]]
    df = spark.createDataFrame([(i, x, "label") for i, x in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r for r in pstable.embedding_links(df, recall=0.9999).collect()}
    use = [i for i, x in enumerate(rows) if x and None not in x and np.isfinite(x).all() and any(x)]
    cos = lambda a, b: len(a) == len(b) and float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))) >= 0.9
    links = {i: set() for i in range(len(rows))}
    for i in use:
        links[i] = {j for j in use if j != i and cos(rows[i], rows[j])}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["component_id"] for i, r in got.items()} == reach(links)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert pstable.embedding_links(df.limit(0)).collect() == []


# Mixing and sharding


def test_transfer():
    rng = random.Random(1)
    for _ in range(300):
        p, q, a, b = rng.random(), rng.random(), rng.randrange(1, 50), rng.randrange(1, 50)
        x, y = mixing.transfer(p, a, q, b, rng.random())
        assert math.isclose(p * a + q * b, x * a + y * b) and (x in (0, 1) or y in (0, 1)) and 0 <= x <= 1 and 0 <= y <= 1


@pytest.mark.parametrize("size", [4096, 16])
def test_mix(spark, monkeypatch, size):
    monkeypatch.setattr(mixing, "BIN", size)
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randrange(1, 60)) for _ in range(900)] + [None, "", "  "]
    sources = [rng.choice(["b", "a", None, "c", "é"]) if i > 300 else "hot" for i in range(len(texts))]
    df = frame(spark, texts, sources)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(texts)
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    mixed, ids = Counter(), Counter()
    for r in out.collect():
        mixed[r["source"]] += len((r["text"] or "").split())
        ids[r["doc_id"]] += 1
    assert max(ids.values()) <= 2 and all(abs(mixed[s] - target[s]) <= 60 for s in target)
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_shards(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 400))) for _ in range(1500)]
    texts += [texts[0]] * 20 + ["hot text " * 20] * 600 + [None, ""]
    df = frame(spark, texts, [rng.choice(["p", "q", None]) for _ in texts])
    got = kdtree.shard(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    load, rows, at = Counter(), {}, {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        rows.setdefault(r["shard"], []).append(r["slot"])
        at.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    mean = sum(load.values()) / 16
    assert sorted(load) == list(range(16)) and max(load.values()) <= 1.15 * mean and min(load.values()) >= 0.85 * mean
    assert all(sorted(x) == list(range(len(x))) for x in rows.values())
    assert all(len(s) == 1 for t, s in at.items() if t != texts[-3])
    assert kdtree.shard(df.limit(0)).collect() == []
    assert len(kdtree.shard(frame(spark, EDGE)).collect()) == len(EDGE)


# Tokens, classifiers


def test_bpe(spark):
    path = queries.tokenizer_path()
    tok = bpe.tokenizer(path)
    rng = random.Random(7)
    parts = ["the,", "The", "don't", "été", "é", "12", "$$$", "<|endoftext|>", "<|startoftext|>x", "　", "\x1c", "日本", "a\x85b", "\n", "\t", "x|y", "I'LL", "word" * 50, "ß.", "<|", "|>"]
    texts = list(EDGE) + [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(900))) for _ in range(60)]
    for t, ids in zip(texts, bpe.encode(path, [t or "" for t in texts], bpe.Store(5000))):
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in bpe.encode_texts(frame(spark, texts), path, keep=True).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == back and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_texts(frame(spark, ["a"]).limit(0), path).collect() == []


def test_bpe_chunks_are_shared():
    rng = random.Random(1)
    shared = " ".join(str(rng.random()) for _ in range(2000))
    a, b = set(bpe.chunks("one " + shared)), set(bpe.chunks("another beginning " + shared))
    assert len(a & b) > 0.9 * len(a)


def test_langid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op7_langid_naive_bayes(spark, SF).collect()}
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in docs.where(crc_mod("doc_id", 4) == 2).collect()]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 if r["held_out"] else True for i, r in got.items())
    model = langid.learn(docs)
    out = langid.identify(frame(spark, [*EDGE, "123 !!"]), model)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.columns.count("score") == 1
    assert [r["lang_pred"] for r in out.orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert out.where("doc_id = 8").first()["lang_pred"] == "und"
    assert langid.identify(frame(spark, ["a b"]), langid.learn(docs.limit(0))).first()["lang_pred"] == "und"


def test_langid_scores_match_sparse_counts():
    rng = np.random.default_rng(3)
    logs, prior = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.log([0.2, 0.3, 0.5])
    for text in ("hello world", "a", "é" * 1000):
        counts = np.bincount(np.concatenate(list(langid.grams(text))), minlength=langid.BUCKETS)
        want = counts @ logs.astype(float) + prior
        lang, p = langid.score([text], ["x", "y", "z"], logs, prior)[0]
        assert lang == "xyz"[int(want.argmax())] and math.isclose(p, np.exp(want.max() - np.logaddexp.reduce(want)), rel_tol=1e-4)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality_random_indexing(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    out = quality.grade(frame(spark, EDGE), model).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").limit(0)) is None
    assert quality.grade(frame(spark, ["x"]), None).first()["score"] == 0.5


# Pages and chats


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b <b>c</b>d</div>", "a\nb cd"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>t", "- x\n- y\n  - z\n\nt"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<table><tr><th>n<th>long<tr><td>alpha<td>1</table>", "n      long\nalpha  1"),
        ("<head><title>t</title><style>p{}</style></head><body>see<script>no()</script><span hidden>h</span><i style='display: none'>d</i></body>", "see"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<pre>a  b\n c</pre>", "a  b\n c"),
        ("x &amp; y &lt;z&gt;<!-- c --> w", "x & y <z> w"),
        ("a </b></i> <unknown>b", "a b"),
        ("<script>never closed <p>x", ""),
        ("5 < 6 and <3", "5 < 6 and <3"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_render(source, text):
    assert html.render(source) == text


def test_pages_against_parser(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("head", "script", "style")
            self.words.append(" ")

        def handle_endtag(self, tag):
            self.off -= tag in ("head", "script", "style")
            self.words.append(" ")

        def handle_data(self, data):
            if not self.off:
                self.words.append(data)

    squeeze = lambda s: "".join(s.replace("- ", "").split())
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html_layout(spark, SF).collect():
        p = Words()
        p.feed(pages[r["page_id"]])
        assert squeeze(r["text"]) == squeeze("".join(p.words))


def test_chat(spark):
    control = "</s>[INST] a|b <|end|>\n <|assistant|>\n &lt; &amp;lt; [/INST]"
    turns = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 2, "assistant", None), (2, 0, None, "x"), (None, None, "we|ird<", ""), (3, 1, "user", "é" * 20000), (3, 0, "assistant", "first"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))
    out = chat.format_chats(df).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("spans"))})
    got = {r["conv_id"]: r for r in out.collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t or 0, r or "", x or "") for c, t, r, x in turns if c == conv), key=lambda z: z)
        assert [tuple(t) for t in got[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert got[conv]["loss"] == "".join(x for _, r, x in own if r == "assistant")
    assert all(c not in chat_body for chat_body in [got[1]["formatted"].replace("<|user|>\n", "").replace("<|assistant|>\n", "").replace("<|end|>\n", "")] for c in ("</s>", "[INST]", "<|", "[/INST]"))
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_parts(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <", None, None), ("image", None, "img1", 9), ("Document", None, "d", 2), ("odd", None, "o", 1)]), (1, 1, "assistant", [("audio", None, "s", 3), ("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, content {chat.PARTS}")
    r = chat.format_chats(df).first()
    assert r["formatted"] == "<|user|>\nsee &lt;<|image|><|document|><|unknown|><|end|>\n<|assistant|>\n<|audio|>ok<|end|>\n<|user|>\n<|end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "img1", 9), (0, "document", "d", 1200), (0, "odd", "o", 0), (1, "audio", "s", 75)]
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["spans"]] == ["<|audio|>ok"]


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123", "en", None, 3)], docs.schema)
    steps = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs.union(extra) if name == "language" else docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps[name] = docs
        if name != "tokens":
            assert docs.columns == P.COLUMNS
    ids = {n: Counter(r["doc_id"] for r in x.select("doc_id").collect()) for n, x in steps.items()}
    assert not {10**6, 10**6 + 1} & set(ids["language"]) and set(ids["quality"]) <= set(ids["language"])
    texts = {r["doc_id"]: r["text"] for r in steps["quality"].collect()}
    order = sorted(texts)
    _, comp = brute_links([texts[i] for i in order])
    assert set(ids["near_duplicates"]) == {order[x] for x in set(comp.values())}
    assert max(ids["mixture"].values()) <= 2 and ids["mixture"] == ids["tokens"]


@pytest.mark.parametrize("name", ["op9_chat_parts", "op10_pstable_neardup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
