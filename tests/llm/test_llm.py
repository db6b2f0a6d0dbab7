"""Every operator of the subpackage against a plain version, on awkward rows and on the smallest tables."""

import functools
import hashlib
import operator
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from loomgraph.llm import blocknames, bpe, embedbag, hashing, langid, linededup, media, mixing, packing, quality, setjoin, warc
from loomgraph.llm import queries as registered
from loomgraph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, id string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def some_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(9)) for i in rng.integers(len(WORDS), size=n))


def awkward():
    base = some_text(1, 60)
    texts = [None, "", " \t\n", "Ünïcode ß 漢字 🙂", base, base, base.upper(), base.replace(" ", "\n"), base + " tail", "one two", "one\ttwo", some_text(2, 9000), "x" * 9000, base + "\x0b", "a\nb\nc\n\nd", "a\nb\nc\n\nd", None]
    rows = [(i, t, "en", ["a", None, "b"][i % 3], 0, 0.5, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[4], (None, base, None, "a", None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(100 + i, re.sub(r"alpha\d", f"near{i}", base, count=1), "en", "a", 0, 0.0, "", "") for i in range(30)]
    rows += [(200 + i, base if i % 2 else some_text(3, 80), "en", "a", 0, 0.0, "", "") for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- 9: exact dedup


def plain_exact(data):
    norm = lambda t: (t or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
    groups = defaultdict(list)
    for i, t in data:
        groups[norm(t)].append((i, len(t or "")))
    out = Counter()
    for i, t in data:
        g = groups[norm(t)]
        most = max(n for _, n in g)
        ids = [x for x, n in g if n == most and x is not None]
        keep = min(ids) if ids else None
        out[i, keep, len(g), i == keep and len(t or "") == most, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(odd, docs, none, block):
    for df in (odd, docs):
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(blocknames.exact_dedup(df, block_bytes=block)))
        assert got == plain_exact([(r["doc_id"], r["text"]) for r in rows(df)])
    assert rows(blocknames.exact_dedup(none)) == []


def test_exact_dedup_when_scans_are_cut_differently(spark, docs, monkeypatch):
    """Another number of cores between two jobs cuts scans elsewhere; no row may be lost by that."""
    want = plain_exact([(r["doc_id"], r["text"]) for r in rows(docs)])
    real, settings = blocknames.stored, iter(["4k", "128m", "16k", "64k"] * 20)

    def other(df):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(settings))
        return real(df)

    monkeypatch.setattr(blocknames, "stored", other)
    try:
        got = blocknames.exact_dedup(docs, block_bytes=64)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(got)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_exact_dedup_of_hot_blocks(spark):
    """Texts that consist of one block or share most of theirs, and are yet told apart."""
    texts = ["z" * n for n in (7, 70_000, 70_000, 70_007)] + ["header " * 3 + str(i // 2) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(blocknames.exact_dedup(df, block_bytes=7)))
    assert got == plain_exact(list(enumerate(texts)))
    named = Counter()
    for r in rows(blocknames.identities(df, block_bytes=7)[1]):
        named[r["uid"]] += 1
    assert set(named.values()) == {1}


# --- 5: n-gram Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_links(data):
    sets = [shingles(t) for _, t in data]
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    index, by_id = defaultdict(list), {}
    for i, s in enumerate(sets):
        if data[i][0] is not None:
            up[root(i)] = root(by_id.setdefault(data[i][0], i))
        seen = Counter(j for x in s for j in index[x])
        for j, o in seen.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                up[root(i)] = root(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (name, _) in enumerate(data):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return Counter((name, len(sets[i]), least.get(root(i)) if sets[i] else name) for i, (name, _) in enumerate(data))


def families():
    """Chains whose ends are not alike, a large family around a text that is not the smallest id, texts with one passage in common, and short ones."""
    rng = np.random.default_rng(5)
    passage, data = some_text(77, 60), []
    for f in range(12):
        words = some_text(100 + f, 40 + 25 * f).split()
        for step in range(14):
            data.append(" ".join(words))
            words = list(words)
            for k in rng.integers(len(words), size=1 + len(words) // 60):
                words[k] = f"w{rng.integers(1 << 30)}"
    centre = some_text(9, 200).split()
    for i in range(150):
        words = list(centre)
        for k in rng.integers(200, size=rng.integers(1, 5)):
            words[k] = f"v{i}x{k}"
        data.append(" ".join(words))
    data.append(" ".join(centre))
    data += [some_text(1000 + i, 30) + " " + passage + " " + some_text(2000 + i, 30) for i in range(60)]
    data += [" ".join(WORDS[: 1 + i % 7]) for i in range(20)]
    return [(i, t) for i, t in enumerate(data)]


def test_jaccard_join(spark, odd, docs, none):
    for df in (odd, docs, spark.createDataFrame(families(), "doc_id long, text string")):
        data = [(r["doc_id"], r["text"]) for r in rows(df)]
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(setjoin.linked_components(df, part_tokens=500)))
        assert got == plain_links(data)
    assert rows(setjoin.linked_components(none)) == []
    kept = {r["doc_id"] for r in rows(setjoin.one_of_each(docs))}
    assert kept == {c for _, _, c in plain_links([(r["doc_id"], r["text"]) for r in rows(docs)])}


def test_jaccard_link_counts(spark, docs, monkeypatch):
    """n_links against all pairs of different sets, with components whole and dealt into many chunks."""
    near = [(i, t) for i, t in families()]
    for df, chunk in ((spark.createDataFrame(near, "doc_id long, text string"), 1000), (spark.createDataFrame(near, "doc_id long, text string"), 20), (docs, 1000)):
        monkeypatch.setattr(setjoin, "CHUNK_SETS", chunk)
        own = {r["doc_id"]: shingles(r["text"]) for r in rows(df)}
        sets, index, links = list(set(own.values())), defaultdict(list), Counter()
        for k, s in enumerate(sets):
            for j, o in Counter(j for x in s for j in index[x]).items():
                if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                    links.update((s, sets[j]))
            for x in s:
                index[x].append(k)
        assert {r["doc_id"]: r["n_links"] for r in rows(setjoin.linked_components(df, part_tokens=500))} == {i: links[s] for i, s in own.items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 150), (150, 120), (7, 7)]
    got = {r["node"]: r["label"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 120: 100}


# --- 7: BPE


@pytest.fixture(scope="module")
def tokens():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(odd, docs, none, tokens):
    for df in (odd, docs):
        want = Counter()
        for r in rows(df):
            ids = tokens.encode_ordinary(r["text"] or "")
            want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
        for forget in (False, True):
            assert Counter(tuple(r) for r in bpe.bpe_round_trip(df, *bpe.vocabulary(), forget=forget).collect()) == want
    assert rows(bpe.bpe_round_trip(none, *bpe.vocabulary())) == []


def test_bpe_long_pieces(tokens):
    rng = np.random.default_rng(3)
    own = bpe.encoder(*bpe.vocabulary())
    for text in ("a" * 5000, "ab" * 3000, "".join(rng.choice(list("theandingstroé"), 4000)), "!?" * 700, " " * 300 + "x", "<|endoftext|>", "\r\n\r\n x"):
        assert own.encode(text).tolist() == tokens.encode_ordinary(text)
    plain = bpe.Encoder(*bpe.vocabulary(), remember=50)
    assert plain.latin and bpe.beyond("a\x1cb") and bpe.beyond("\u0250") and not bpe.beyond("aß\u024f")
    texts = ["".join(rng.choice(list("abcdeinotrsühé漢🙂 \x1c\n1²'"), n)) for n in rng.integers(0, 400, 200)] + ["the and in an " * 400_000, "banana" * 30_000]
    assert [bpe.numbers(x).tolist() for x in plain.id_texts(texts)] == [tokens.encode_ordinary(t) for t in texts]
    assert all(plain.decode(x).decode() == t for x, t in zip(plain.id_texts(texts), texts, strict=True))
    own.forget()
    assert not own.packed and not own.packed.older
    for _ in range(300):
        text = "".join(rng.choice(list("abcdeino "), rng.integers(1, 60)))
        assert own.encode(text).tolist() == tokens.encode_ordinary(text)


# --- 8: mixing


def plain_targets(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, stopped = share * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in sizes if s not in stopped)
        left = whole - sum(cap * sizes[s] for s in stopped)
        over = {s for s in sizes if s not in stopped and left * weight[s] / free > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in stopped else left * weight[s] / free for s in sizes}
        stopped |= over


def test_mixing(odd, docs, none):
    for df in (odd, docs):
        own = pd.DataFrame(rows(mixing.plan(df)))
        data = rows(df)
        assert sorted(own["size"]) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in data)
        sizes = Counter()
        for r in data:
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        want = plain_targets(dict(sizes))
        for source, g in own.groupby(own["source"].fillna("?"), dropna=False):
            source = None if source == "?" else source
            assert g["source_size"].eq(sizes[source]).all() and np.allclose(g["target"], want[source])
            assert want[source] >= g["taken"].sum() - 1e-6
            small = g[(g["taken"] < 2 * g["size"]) & (g["size"] > 0)]["size"]
            assert want[source] - g["taken"].sum() <= max(0.05 * want[source], small.min() if len(small) else 1), source
        assert (own["taken"] <= 2 * own["size"]).all() and (own["taken"] % own["size"].clip(lower=1) == 0).all()
        times = [t for p in own["positions"] for t in p]
        assert min(times) >= 0 and max(times) <= 1
        key = lambda x: sorted(map(str, x.to_dict("records")))
        assert key(pd.DataFrame(rows(mixing.plan(df.repartition(5))))) == key(own)
    assert rows(mixing.plan(none)) == []
    order = rows(mixing.curriculum(docs))
    times = [r["first_position"] for r in order if r["first_position"] is not None]
    assert times == sorted(times) and all(r["first_position"] is None for r in order[len(times) :])


@pytest.mark.parametrize("schedules", [mixing.SCHEDULES, ((0.0, 1.0, 0.0), (3.0, 1.0), (1.0, 0.0, 0.0, 5.0))])
def test_curriculum_follows_schedules(docs, schedules):
    """Each source's share of the tokens up to time t is the integral of its schedule."""
    own = [r for r in rows(mixing.plan(docs, schedules=schedules)) if r["positions"]]
    done = defaultdict(list)
    for r in own:
        done[r["source"]] += [(t, r["size"], r["target"]) for t in r["positions"]]
    order = sorted({r["source"] for r in rows(docs)})
    for s in sorted(done):
        rates = schedules[order.index(s) % len(schedules)]
        grid = np.linspace(0, 1, 100_001)
        rate = np.interp(grid, np.linspace(0, 1, len(rates)), rates)
        demand = np.concatenate(([0], np.cumsum((rate[1:] + rate[:-1]) / 2)))
        demand /= demand[-1]
        before = 0
        for t, size, target in sorted(done[s]):
            assert abs(target * np.interp(t, grid, demand) - before) <= max(x for _, x, _ in done[s]) * 2 + 1e-3 * target
            before += size


def test_mixed_by_rows(spark):
    """Repeated ids, repeated rows, null ids and columns that clash: as many rows of each text as the plan has copies."""
    data = [(i % 40 if i % 7 else None, some_text(600 + i % 60, 5 + i % 30), ["a", None, "b"][i % 3], i % 2) for i in range(200)] + [(5, "same words here", "a", 1)] * 30 + [(6, None, "a", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, mix_0 long")
    got = rows(mixing.mixed(df))
    assert set(got[0]) == set(df.columns)
    each = Counter((r["doc_id"], r["text"], r["source"], r["mix_0"]) for r in got)
    there = Counter(data)
    assert all(v <= 2 * there[k] for k, v in each.items())
    sizes, words = Counter(), Counter()
    for _, text, source, _ in data:
        sizes[source] += len((text or "").split())
    for r in got:
        words[r["source"]] += len(r["text"].split())
    for s, target in plain_targets(dict(sizes)).items():
        assert target - 35 <= words[s] <= target + 1e-6
    assert each == Counter((r["doc_id"], r["text"], r["source"], r["mix_0"]) for r in rows(mixing.mixed(df.repartition(3))))


def test_mixing_tells_null_from_blank(spark):
    """A null id and a blank one are two documents; rows of one id and size that are very many are counted out in stretches."""
    df = spark.createDataFrame([(None, some_text(1, 10), "a"), ("", some_text(2, 10), "a")], "doc_id string, text string, source string")
    assert sum(r["taken"] for r in rows(mixing.plan(df))) == 30
    many = spark.createDataFrame([("x", "one two", "a")] * 2500 + [("y", "three", "b")] * 3, "doc_id string, text string, source string")
    got = rows(mixing.plan(many))
    assert len(got) == 2503 and Counter(r["doc_id"] for r in got) == {"x": 2500, "y": 3}
    assert abs(sum(r["taken"] for r in got if r["doc_id"] == "x") - got[0]["target"]) <= 10 or got[0]["doc_id"] == "y"
    assert len(rows(mixing.mixed(many))) == sum(len(r["positions"]) for r in got)


# --- 4: media


def test_media(odd, docs, none):
    for df in (odd, docs):
        text = defaultdict(list)
        for r in rows(df):
            text[r["doc_id"]].append(r["text"])
        seen = {}
        for r in rows(media.text_media(df, with_media=True)):
            ok = False
            for t in text[r["doc_id"]]:
                data = (t or "").encode()
                payload = data + bytes(-len(data) % 64) if data else bytes(64)
                ok |= (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) and seen.setdefault(payload, r["feature"]) == r["feature"]
            assert ok and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["feature"]) == 16
    assert rows(media.text_media(none)) == []


def test_png_reader():
    """Rows under every filter, written by a plain encoder; broken files are refused."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (11, 6), dtype=np.uint8)
    kinds = [4, 3, 2, 1, 0, 4, 2, 2, 3, 1, 4]
    raw = bytearray()
    for y, kind in enumerate(kinds):
        raw.append(kind)
        for i in range(6):
            a, b, c = (int(x[y, i - 1]) if i else 0), (int(x[y - 1, i]) if y else 0), (int(x[y - 1, i - 1]) if y and i else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((int(x[y, i]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    assert (media.unfiltered(np.frombuffer(bytes(raw), np.uint8).reshape(11, 7)) == x).all()
    image = media.encode_png(bytes(range(256)))
    assert media.decode_png(image).tobytes() == bytes(range(256))
    for at in (3, 20, len(image) // 2, len(image) - 5):
        with pytest.raises(media.BadImage):
            media.decode_png(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])
    with pytest.raises(media.BadImage):
        media.decode_png(image[:-4])
    near = media.cosine_hash(np.stack([media.reduced(np.add.outer(np.arange(40), np.arange(64)).astype(np.uint8)), media.reduced(np.add.outer(np.arange(41), np.arange(64)).astype(np.uint8))]))
    assert bin(int(near[0], 16) ^ int(near[1], 16)).count("1") <= 8


# --- 6: WARC


def test_warc(spark, sf_dir, none):
    big = "<p>" + "é" * 700 + "</p>"
    data = [(1, "http://b.example/x", big), (9, "http://B.example/x#f", big), (4, None, big), (5, "http://a.example/\r\nEvil: 1", None), (6, "", ""), (7, "u", "small"), (8, "u", "small"), (9, "http://b.example/x", big), (None, "http://c.example", big), (10, "http://d.example", "a\r\n\r\nWARC/1.1\r\n\r\n")]
    for pages in (spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", warc.F.lit(1)), spark.read.parquet(f"{sf_dir}/pages.parquet")):
        want = Counter()
        known = rows(pages)
        last = {}
        for r in known:
            last[r["html"]] = max(last.get(r["html"], -1), -1 if r["page_id"] is None else r["page_id"])
        for r in known:
            body = (r["html"] or "").encode()
            again = len(body) >= 1000 and r["page_id"] != last[r["html"]]
            want[r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[r["html"]] if again else None] += 1
        got = rows(warc.archive(pages))
        assert Counter(tuple(r[c] for c in warc.ORACLE_COLUMNS) for r in got) == want
        order = sorted(got, key=lambda r: (r["shard"], r["place"]))
        assert [(r["url_key"], r["time"]) for r in order] == sorted((r["url_key"], r["time"]) for r in got)
    assert rows(warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))) == []


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_warc_dates_are_utc(spark, zone):
    import datetime

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        pages = spark.createDataFrame([(i, f"http://a.example/{i}", "x") for i in (0, 7, 10_000_000, 31_000_000)], "page_id long, url string, html string")
        path = warc.fresh_path(spark, "warc")
        warc.write_archives(pages, path)
        dates = sorted(r["value"][11:] for r in spark.read.text(f"{path}/*").where("value like 'WARC-Date: %'").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [d.strip() for d in dates] == [datetime.datetime.fromtimestamp(warc.EPOCH + i, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for i in (0, 7, 10_000_000, 31_000_000)]


def test_warc_sizes_and_ranges(spark):
    """Pages of all size classes, and more captures of one URL, time and page than a range holds."""
    data = [(i % 7, "http://a.example/", "x" * (3 + i)) for i in range(500)] + [(900, "http://b.example/", "y" * 200_000), (901, "http://b.example/", "z" * 5_000_000), (902, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    path = warc.fresh_path(spark, "warc")
    got = rows(warc.archive(pages, path))
    assert Counter((r["page_id"], r["payload_digest"]) for r in got) == Counter((i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in data)
    assert {r["file"].split("/")[0] for r in got} == {"sizes-0", "sizes-1", "sizes-2"}
    few = rows(warc.merged_index(warc.stored(warc.read_runs(spark, path)), range_rows=20))
    assert max(Counter(r["shard"] for r in few).values()) < 120 and len({r["shard"] for r in few if r["url_key"] == "example,a)/"}) > 5
    order = sorted(few, key=lambda r: (r["shard"], r["place"]))
    key = lambda r: (r["url_key"], r["time"], -1 if r["page_id"] is None else r["page_id"], r["file"], r["offset"])
    assert list(map(key, order)) == sorted(map(key, few))


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in range(0, 12):
        runs = [sorted((int(x), k) for x in rng.integers(0, 50, rng.integers(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert warc.url_key("https://www.Example.com:8080/A?B=1#c") == "com,example:8080)/a?b=1"


# --- 10: line dedup


def counted(lines, run, words):
    """All runs of at most ``run`` lines that count, as (begin, end)."""
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    return [(i, j) for i in range(len(lines)) for j in range(i + 1, min(len(lines), i + run) + 1) if j - i == run or sum(n[i:j]) >= words]


def check_lines(data, got, run=3, words=50):
    """A line is gone if and only if it is part of a run that counts and occurs earlier, and not of that run's own first occurrence; all by comparing lines themselves."""
    texts, first = [], {}
    for d, (_, t) in enumerate(data):
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n"))]
        texts.append([(i, x) for i, x in lines if x])
        own = [x for _, x in texts[-1]]
        for a, b in counted(own, run, words):
            first.setdefault(tuple(own[a:b]), (d, a, b))
    for d, (name, t) in enumerate(data):
        assert got[d][0] == name
        own = [x for _, x in texts[d]]
        gone = {k for k, (i, _) in enumerate(texts[d]) if any(r["first"] <= i <= r["last"] for r in got[d][3])}
        want = set()
        for a, b in counted(own, run, words):
            e, c, f = first[tuple(own[a:b])]
            if (e, c) < (d, a):
                want |= {k for k in range(a, b) if e != d or k >= f}
        assert gone == want, (name, gone ^ want)
        numbers = {texts[d][k][0] for k in gone}
        assert got[d][1] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in numbers)) and got[d][2] == len(gone)


def deduped(df, **options):
    return sorted(((r["doc_id"], r["text"], r["lines_removed"], [x.asDict() for x in r["runs"]]) for r in rows(linededup.line_dedup(df, **options))), key=lambda r: r[0])


@pytest.mark.parametrize("run, words", [(3, 50), (4, 7), (2, 1000)])
def test_line_dedup(spark, docs, run, words):
    rng = np.random.default_rng(4)
    lines = [f"line {i}" for i in range(12)] + ["", "  ", some_text(5, 55)]
    data = [(i, "\n".join(lines[k] for k in rng.integers(len(lines), size=rng.integers(0, 14)))) for i in range(60)] + [(60, None), (61, "a\na\na\na\na"), (62, "  a\n\na\na \na")]
    for df in [spark.createDataFrame(data, "doc_id long, text string")] + [docs] * (run == 3):
        own = sorted((r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text").fillna("", "text")))
        if df is not docs:
            own = data
        check_lines(own, deduped(df.select("doc_id", "text")), 3, 50) if run == 3 else check_lines(own, deduped(df, run=run, words=words), run, words)


def test_line_dedup_awkward(odd, none):
    got = rows(linededup.line_dedup(odd))
    assert len(got) == odd.count() and sum(r["text"] is None for r in got) == sum(r["text"] is None for r in rows(odd))
    assert rows(linededup.line_dedup(none)) == []


def test_line_dedup_short_runs(spark):
    """Runs of fewer lines than a window that only together have 50 words."""
    a, b, c, d = (some_text(300 + i, n) for i, n in enumerate((47, 38, 26, 25)))
    data = [(0, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, f"one\n{c}\n\n {d}\ntwo"), (3, f"three\n{c}\n{d}\nfour"), (4, f"{b}\n{a}"), (5, c), (6, f"{c}\nshort"), (7, f"x\n{b}\n{a}")]
    got = {r["doc_id"]: r["text"] for r in rows(linededup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got == dict(data) | {1: "", 3: "three\nfour", 7: "x"}


def test_line_dedup_of_common_lines(spark):
    """A line that all texts have, in other company each time, hides no repeated run."""
    fill = iter(f"filler {i}" for i in range(10_000))
    data = [(i, "\n".join([next(fill), "common", next(fill), "common", next(fill)])) for i in range(50)]
    data += [(50 + i, "\n".join([next(fill), "common", "left", "common", "right", next(fill)])) for i in range(6)]
    got = deduped(spark.createDataFrame(data, "doc_id long, text string"))
    check_lines(data, got)
    assert [g[2] for g in got] == [0] * 51 + [4] * 5


def test_line_dedup_fingerprints():
    """Minima chosen by a plain loop: distinct places, far fewer than windows, and every window holds one of its own."""
    rng = np.random.default_rng(8)
    h, sizes = rng.integers(0, 1 << 40, 4000, dtype=np.uint64), rng.integers(1, 70, 4000).astype(np.int32)
    sizes[500:] = 2
    begin, end, place = linededup.windows(h, sizes, 3, 50)
    want = set()
    for i in range(len(h)):
        for step in (1, -1):
            n = 0
            for j in range(i, max(-1, i - 3) if step < 0 else min(len(h), i + 3), step):
                n += int(sizes[j])
                if n >= 50 or abs(j - i) == 2:
                    low, high = min(i, j), max(i, j) + 1
                    own = h[low:high].tolist()
                    want.add((low, high, max(k for k in range(low, high) if h[k] == min(own))))
                    break
    assert list(zip(begin.tolist(), end.tolist(), place.tolist())) == sorted(want)
    assert len(set(place[600:].tolist())) < 0.6 * len(place[600:])


def test_line_dedup_keeps_the_first_of_what_overlaps(spark):
    """A text that repeats itself keeps the first occurrence of the run it repeats; so does one that a later text repeats."""
    data = [(0, "\n".join(["a b c"] * 6)), (1, "\n".join(["a b c", "d e f"] * 4)), (2, "\n".join(["x", some_text(9, 60), some_text(9, 60), "y", "a b c", "d e f", "a b c"]))]
    got = deduped(spark.createDataFrame(data, "doc_id long, text string"))
    check_lines(data, got)
    assert got[0][1] == "a b c\na b c\na b c" and got[1][1] == "a b c\nd e f\na b c" and got[2][1].split("\n")[::2] == ["x", "y"]


def test_line_dedup_of_tails(spark):
    """A short line after a long one goes if both occur together, wherever the long one was first."""
    long_ = some_text(10, 60)
    data = [(0, f"{long_}\nother"), (1, f"p\n{long_}\ntail\nq"), (2, f"r\n{long_}\ntail\ns"), (3, f"tail\n{long_}"), (4, f"tail\n{long_}")]
    got = deduped(spark.createDataFrame(data, "doc_id long, text string"))
    check_lines(data, got)
    assert [g[1] for g in got] == [data[0][1], "p\ntail\nq", "r\ns", "tail", ""]


def test_line_dedup_of_long_texts(spark):
    """Two copies of a text of 40,000 short lines, and one that shares every third line with it: in proportion to their lines."""
    lines = [f"row {i} of a long text" for i in range(40_000)]
    mixed = [x if i % 3 else f"other {i}" for i, x in enumerate(lines)]
    got = deduped(spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(lines)), (2, "\n".join(mixed))], "doc_id long, text string"))
    assert [g[2] for g in got] == [0, 40_000, 0]


# --- 1: packing


def test_packing(odd, docs, none, tokens):
    for df in (odd, docs):
        for length, window in ((64, 3000), (2048, 1 << 21)):
            got, placed = rows(packing.pack(df, *bpe.vocabulary(), length=length, window=window)), defaultdict(list)
            for r in got:
                ids, places = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
                assert len(ids) == len(places) == length and r["cu_seqlens"][-1] == r["n_tokens"] <= length
                for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
                    assert places[a:b].tolist() == list(range(b - a))
                    placed[r["doc_ids"][k]].append((r["doc_offsets"][k], ids[a:b].tolist()))
                assert not places[r["n_tokens"] :].any()
            want = defaultdict(list)
            for r in rows(df):
                ids = [*tokens.encode_ordinary(r["text"] or ""), 50256]
                want[r["doc_id"]] += [(a, ids[a : a + length]) for a in range(0, len(ids), length)]
            assert {k: sorted(v) for k, v in placed.items()} == {k: sorted(v) for k, v in want.items()}
            assert len({(r["shard"], r["row"]) for r in got}) == len(got)
    assert rows(packing.pack(none, *bpe.vocabulary())) == []


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        most = int(rng.integers(5, 70))
        lengths = rng.integers(1, most + 1, rng.integers(1, 80)).tolist()
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = [r for r in rooms if r >= lengths[i]]
            if fit:
                rooms[rooms.index(min(fit))] -= lengths[i]
            else:
                rooms.append(most - lengths[i])
        bins = packing.best_fit_decreasing(lengths, most)
        want = sorted(rooms)
        assert sorted(most - sum(lengths[i] for i in b) for b in bins) == want
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


# --- 2 and 3: classifiers


def test_language_id(spark, odd, none):
    path = "/root/testdata/sf0.01"
    got = pd.DataFrame(rows(langid.query(spark, path))).set_index("doc_id")
    truth = spark.read.parquet(f"{path}/documents.parquet").toPandas().set_index("doc_id")
    both = got.join(truth[["lang", "text"]])
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.index]).all()
    assert (both["lang_pred"] == both["lang"])[both["held_out"]].mean() >= 0.98 and both["score"].between(0, 1).all()
    model = langid.fit(spark.read.parquet(f"{path}/documents.parquet"), bound=150)
    known = Counter((r["doc_id"], not any(c.isalpha() for c in r["text"] or "")) for r in rows(odd))
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in rows(langid.identify(odd, model))) == known
    assert rows(langid.identify(none, model)) == []
    blank = langid.fit(none)
    assert rows(langid.identify(none, blank)) == [] and {(r["lang_pred"], r["score"], r["accepted"]) for r in rows(langid.identify(odd, blank))} == {("und", 0.0, False)}


def test_labelled_sample(spark):
    """Rows that repeat an id count once, whatever the order they come in, and no more than the bound are taken."""
    data = [(i % 50, f"text {i}", ["en", "de"][i % 2]) for i in range(600)] + [(None, "x", "en"), (7, None, None)]
    got = []
    for k in (1, 5):
        df = spark.createDataFrame(data, "id long, text string, label string").repartition(k)
        got.append(langid.labelled_sample(df.select("id", "label"), df.where("label is not null"), 20))
    assert got[0] == got[1] and len(got[0][0]) == 20 and len(set(got[0][0])) == 20
    assert langid.labelled_sample(df.select("id", "label"), df, 0) == ([], [])


def test_quality(spark, odd, none):
    path = "/root/testdata/sf0.01"
    got = pd.DataFrame(rows(quality.query(spark, path))).set_index("doc_id")
    truth = spark.read.parquet(f"{path}/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(truth, how="inner")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (both["predicted"] == both["quality"])[both["held_out"]].mean() >= 0.95
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    model = quality.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"), bound=100)
    scored = rows(quality.score(odd, model))
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored) and set(scored[0]) == set(odd.columns) | {"predicted"}
    assert rows(quality.score(none, model)) == []
    blank = quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert rows(quality.score(none, blank)) == [] and {(r["score"], r["predicted"]) for r in rows(quality.score(odd, blank))} == {(0.5, 1)}
    assert set(rows(quality.score(odd, model, score_col="own", predicted_col="kept"))[0]) == set(odd.columns) | {"own", "kept"}


def plain_features(text, features):
    """(bucket, weight) of each feature, by loops over words and characters."""
    top = 1 << 64

    def mixed(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % top
        h ^= h >> 29
        h = h * 0xC4CEB9FE1A85EC53 % top
        return h ^ h >> 32

    bits, kinds = features.buckets.bit_length() - 1, []
    own = []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        h = sum((b + 1 + 32 * (65 <= b <= 90)) * pow(0x9E3779B97F4A7C15, k, top) for k, b in enumerate(word)) % top
        own.append(mixed(h))
    kinds.append([h >> (64 - bits) for h in own])
    for n in range(2, features.words + 1):
        kinds.append([mixed(functools.reduce(operator.xor, own[i : i + n])) >> (64 - bits) for i in range(len(own) - n + 1)])
    chars = [ord(c) + 32 * (features.lower and "A" <= c <= "Z") for c in text]
    for n in features.grams:
        own = []
        for i in range(len(chars) - n + 1):
            code = n
            for c in chars[i : i + n]:
                code = code * 0x01000193 % (1 << 32) ^ c
            code ^= code >> 15
            code = code * 0x85EBCA6B % (1 << 32)
            code ^= code >> 13
            code = code * 0x9E3779B1 % (1 << 32)
            own.append(code >> (32 - bits))
        kinds.append(own)
    return [(b, 1 / (len(own) * features.kinds)) for own in kinds for b in own]


@pytest.mark.parametrize("features", [langid.FEATURES, quality.FEATURES])
def test_features_and_scores_against_loops(features):
    texts = ["Ünïcode ß 漢字 🙂 words", "", None, "The the cat\nsat  on", "x", some_text(4, 90)]
    model = embedbag.Model([0, 1, 2], features, np.random.default_rng(0).normal(size=(features.buckets, 3)).astype(np.float32), np.array([0.1, -0.2, 0.3]), temperature=1.7)
    want = []
    for text in texts:
        z = model.bias.copy()
        for bucket, weight in plain_features(text or "", features):
            z += weight * model.table[bucket].astype(float)
        want.append(z)
    assert np.allclose(model.logits(pa.array(texts)), want, atol=1e-5)
    z = np.exp(np.array(want) / 1.7)
    assert np.allclose(model.probabilities(pa.array(texts)), z / z.sum(axis=1, keepdims=True), atol=1e-5)


def test_training_against_loops():
    """A few steps of gradient descent, number by number."""
    features, texts, labels = embedbag.Features(buckets=1 << 8, grams=(2,)), ["ab cd", "ab", "x y z", "cd x"], ["p", "q", "p", "q"]
    dim, steps, rate = 3, 12, 2.0
    model = embedbag.train(texts, labels, features, dim=dim, epochs=3, steps=steps, rate=rate, seed=5)
    rng = np.random.default_rng(5)
    emb = rng.normal(0, 0.1, (features.buckets, dim)).astype(np.float32).tolist()
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32).tolist()
    bias, done = [0.0, 0.0], 0
    for _ in range(3):
        for i in rng.permutation(np.arange(4)):
            weights = defaultdict(float)  # by kind, as the same bucket of two kinds is updated once for each
            kinds = {}
            for n, (b, w) in enumerate(plain_features(texts[i], features)):
                kind = 0 if n < len(texts[i].split()) else 1
                weights[kind, b] += w
            lr = rate * (1 - done / steps) + 0.01
            done += 1
            mean = [sum(w * emb[b][d] for (_, b), w in weights.items()) for d in range(dim)]
            z = [sum(mean[d] * out[d][c] for d in range(dim)) + bias[c] for c in range(2)]
            e = [np.exp(x - max(z)) for x in z]
            p = [x / sum(e) for x in e]
            p[["p", "q"].index(labels[i])] -= 1
            back = [sum(out[d][c] * p[c] for c in range(2)) for d in range(dim)]
            norm = sum(w * w for w in weights.values()) + 1e-3
            for (_, b), w in weights.items():
                assert b not in kinds, "buckets must differ here"
                kinds[b] = True
                for d in range(dim):
                    emb[b][d] -= w * 0.25 / norm * lr * 0.2 * back[d]
            for d in range(dim):
                for c in range(2):
                    out[d][c] -= lr * 0.2 * mean[d] * p[c]
            for c in range(2):
                bias[c] -= lr * 0.05 * p[c]
    want = np.array(emb) @ np.array(out)
    assert np.allclose(model.table, want, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-4)


def test_model_reads_whole_texts_one_by_one():
    texts = ["the cat sat on the mat"] * 30 + ["der hund lief in den wald"] * 30
    model = embedbag.train(texts, ["en"] * 30 + ["de"] * 30, embedbag.Features(buckets=1 << 12), epochs=4)
    batch = [None, "", "the mat", "x" * 3_000_000 + " the", "wald hund", "the mat"]
    p = model.probabilities(pa.array(batch))
    for i, t in enumerate(batch):
        assert np.allclose(p[i], model.probabilities(pa.array([t], pa.string()))[0])
    assert model.classes[p[2].argmax()] == "en" and model.classes[p[4].argmax()] == "de"


def test_rejection_keeps_its_promise(monkeypatch):
    """Sure but wrong predictions take the threshold beyond 0.95."""
    margin = np.array([80.0] * 10 + [-60.0] + [60.0] * 9)  # of the right class, text by text kept back
    monkeypatch.setattr(embedbag.Model, "logits", lambda self, column: np.stack([margin, 0 * margin], axis=1))
    model = embedbag.train(["x"] * 100, ["b"] + ["a"] * 99, embedbag.Features(buckets=1 << 6), epochs=1, steps=1)
    assert model.reject_below > 0.95
    p = embedbag.softmax(np.stack([margin, 0 * margin], axis=1) / model.temperature)
    accepted = p.max(axis=1) >= model.reject_below
    assert accepted.sum() == 10 and (margin[accepted] > 0).all()


def test_hashing():
    texts = ["A b\tC", "", "  x ", "éa b\x0cc", "d"]
    for _, _, data, ends in hashing.chunks(pa.array(texts)):
        a, b, words = hashing.word_spans(data, ends)
        got = [[bytes(data[a[k] : b[k]]).decode() for k in range(words[i], words[i + 1])] for i in range(5)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    for t in ("a b c d e f", "a b c d e a b c d e f", "a b"):
        one = hashing.shingle_sets(*[x[2:] for x in hashing.chunks(pa.array([t]))][0])[0]
        assert len(one) == len(shingles(t))


# --- the pipeline


def test_pipeline(spark, sf_dir, docs, tokens):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mixing", "encoding"]
    now = docs
    good = rows(corpus_pipeline.keep_good(spark, now, sf_dir))
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))}
    kept = {r["doc_id"] for r in good}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    now = corpus_pipeline.stored(spark.createDataFrame(good, docs.schema))
    exact = {r["doc_id"] for r in rows(corpus_pipeline.drop_copies(spark, now, sf_dir))}
    assert exact == {k[0] for k in plain_exact([(r["doc_id"], r["text"]) for r in good]) if k[3]}
    now = now.where(blocknames.F.col("doc_id").isin(*exact))
    near = {r["doc_id"] for r in rows(corpus_pipeline.drop_near_copies(spark, now, sf_dir))}
    data = [(r["doc_id"], r["text"]) for r in rows(now)]
    assert near == {i for i, _, c in plain_links(data) if i == c}
    now = now.where(blocknames.F.col("doc_id").isin(*near))
    taken = Counter(r["doc_id"] for r in rows(corpus_pipeline.mix(spark, now, sf_dir)))
    assert set(taken.values()) <= {1, 2} and set(taken) <= near
    out = rows(corpus_pipeline.run(spark, sf_dir))
    assert Counter(r["doc_id"] for r in out) == taken
    text = {r["doc_id"]: r["text"] for r in rows(docs)}
    assert all(r["n_tokens"] == len(tokens.encode_ordinary(text[r["doc_id"]])) for r in out)


def test_stages_leave_each_other_alone(spark, docs, sf_dir):
    """A stage's result can be read after others have run, also on other documents, and what it doesn't read is gone."""
    a = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    want = sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, sf_dir).collect())
    b = corpus_pipeline.drop_near_copies(spark, docs.limit(50), sf_dir)
    c = corpus_pipeline.mix(spark, docs, sf_dir)
    assert b.count() <= 50 and c.count() > 0 and sorted(r["doc_id"] for r in a.collect()) == want


def test_pipeline_by_rows(spark, tmp_path):
    """Repeated ids and rows, null ids, columns that clash with the operators' own: stage by stage against plain versions of them by rows."""
    base, other = some_text(1, 60), some_text(2, 80)
    data = [(1, base, "a"), (1, other, "a"), (1, "quite another text of its own", "a"), (None, base + " ", "a"), (None, some_text(3, 30), None), (2, other, "b"), (2, other, "b"), (3, other.replace(" ", "\n", 1), "b"), (4, None, "a"), (5, "", "a"), (6, re.sub(r"^\S+", "zzz", other), "c"), (None, re.sub(r"^\S+", "yyy", base), "c")]
    data = [(i, t, s, 0.5, 1, "m", "k") for i, t, s in data]
    schema = "doc_id long, text string, source string, score double, predicted int, mix_id string, key string"
    docs = spark.createDataFrame(data, schema)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = corpus_pipeline.stored(corpus_pipeline.keep_good(spark, docs, str(tmp_path)))
    assert now.columns == docs.columns and now.count() == len(data)
    now = corpus_pipeline.stored(corpus_pipeline.drop_copies(spark, now, str(tmp_path)))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for i, t, *_ in data:
        rank = (-len(t or ""), i is None, i or 0)
        best[norm(t)] = min(best.get(norm(t), rank), rank)
    got = [(r["doc_id"], r["text"]) for r in rows(now)]
    assert now.columns == docs.columns and sorted(norm(t) for _, t in got) == sorted(best)
    assert all((-len(t or ""), i is None, i or 0) == best[norm(t)] for i, t in got)
    near = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, now, str(tmp_path)))
    sets, groups = [shingles(t) for _, t in got], list(range(len(got)))
    for _ in got:
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    groups[x] = groups[y] = min(groups[x], groups[y])
    want = Counter()
    for g in set(groups):
        want[min((i is None, i or 0) for k, (i, _) in enumerate(got) if groups[k] == g)] += 1
    assert near.columns == docs.columns and Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in rows(near)) == want
    mixed = corpus_pipeline.stored(corpus_pipeline.mix(spark, near, str(tmp_path)))
    assert mixed.columns == docs.columns and set(Counter(r["text"] for r in rows(mixed)).values()) <= {1, 2}
    assert corpus_pipeline.encode(spark, mixed, str(tmp_path)).count() == mixed.count()


def test_pipeline_and_queries_of_empty_tables(spark, tmp_path):
    """No rows in, no rows out, for every query of the subpackage."""
    for name, schema in {"documents": SCHEMA, "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registered.queries().items():
        assert rows(query(spark, str(tmp_path))) == [], name
