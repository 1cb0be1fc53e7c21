"""The training-data operators against brute force, round trips and edge cases."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docscope.llm import decontamination, html_text, line_dedup, minhash, packing, quality, registry, sharding, token_files, tokens, toxicity, url_filter
from docscope.llm.common import shared_dir, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGE = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, "word", "xx"), (5, LONG, "en"), (6, LONG, "en"), (7, "a b c d e f g h " * 40, "en"),
    (8, "Ünïcode ﬁ <|endoftext|> don't \x1c x\u00a0y", "de"), (9, "same text here again", "en"), (10, "Same text here again", "en"),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    return df.withColumn("shard", F.lit("clash")).withColumn("n_words", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def library():
    return tokens.encoder().tokenizer


def true_ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sorted(map(tuple, sharding.shard_by_bytes(df).collect()))
    sizes = {d: len((t or "").encode()) + 8 for d, t in texts(df).items()}
    total, at, slots = sum(sizes.values()), 0, collections.Counter()
    for (doc_id, size, crc, law, shard, slot, grown), t in zip(got, [texts(df)[d] for d in sorted(sizes)], strict=True):
        assert (size, crc, law, grown) == (sizes[doc_id], zlib.crc32((t or "").encode()), "bytes", None)
        assert shard == min(23, (2 * at + size) * 24 // (2 * total))
        assert slot == slots[shard]
        slots[shard] += 1
        at += size


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_token_files(request, spark, library, which):
    df = request.getfixturevalue(which)
    shards = token_files.write_token_files(df, shared_dir(spark, "t"), seq_len=64)
    got, start = sorted(map(tuple, token_files.read_documents(spark, shards).collect())), 0
    for (d, t), row in zip(sorted(texts(df).items()), got, strict=True):
        ids = true_ids(library, t)
        assert row == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    reader = token_files.ShardReader(shards[0][1])
    ids, mask = reader.sequence(len(reader) - 1)
    assert len(ids) == len(mask) == 64 and ids.base is not None
    assert sum(reader.sequence(i)[1].true_count for i in range(len(reader))) == shards[0][3]


def test_encoder_is_the_library(library):
    code = tokens.encoder()
    for t in ["don't I'LL x'''s 'S", "<|endoftext|> a<|endoftext|>b", "É e\u0301 ΑΣ. İx", "a\u2003b\u00a0c\x1cd", "日本語。x²½", "a_b 3,000", "''s", "x" * 500]:
        assert code.encode(t) == code.library(t)


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_packing(request, library, which):
    df = request.getfixturevalue(which)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(df).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in texts(df).items():
        ids, at = true_ids(library, t), 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc and sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_pack_histogram():
    histogram = {4096: 3, 4000: 5, 96: 4, 50: 7, 1: 9}
    patterns = packing.pack_histogram(histogram)
    used = collections.Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 4096
        used.update({k: v * n for k, v in collections.Counter(pattern).items()})
    assert used == histogram


def shingle_sets(df):
    out = {}
    for d, t in texts(df).items():
        w = WORD.findall((t or "").translate(LOWER))
        out[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    return out


def brute_components(sets):
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if v == hi else v for d, v in label.items()}
    return label


@pytest.mark.parametrize("which", ["edge", "near", "docs"])
def test_minhash(request, spark, which):
    if which == "near":  # chains of near copies, so that first and last of a chain are not linked
        base = [f"v{i}" for i in range(60)]
        rows = [(k, " ".join(base[: 60 - 0] if not k else [*base[: 60 - k], *(f"n{j}" for j in range(k))])) for k in range(12)]
        df = spark.createDataFrame([*rows, (50, rows[3][1]), (60, "other words entirely in this one")], "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    sets = shingle_sets(df)
    label = brute_components(sets)
    for r in minhash.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_components_by_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102)], "a long, b long")
    want = sorted([(i, 1) for i in range(1, 31)] + [(100, 100), (101, 100), (102, 100)])
    assert sorted(map(tuple, minhash.components(edges).collect())) == want
    assert sorted(map(tuple, minhash.components(edges, at_once=0).collect())) == want


def test_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 60, 4000).astype(np.uint64))
    b = np.concatenate([a[:3600], rng.integers(0, 1 << 60, 400).astype(np.uint64)])
    x, y = (np.frombuffer(minhash.packed(minhash.minima(np.unique(s), minhash._WIDE_ODD)), np.uint8) for s in (a, b))
    assert minhash.estimates(x, y) == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)), abs=0.06)


def test_line_dedup(spark):
    passage = ["the shared first line has words " + " ".join(f"p{i}" for i in range(30)), "and a second " + " ".join(f"q{i}" for i in range(26))]
    own = lambda k: [f"own line {k} number {j} " + " ".join(f"u{k}x{j}x{i}" for i in range(12)) for j in range(5)]
    rows = [(k, "\n".join([*own(k)[:2], *passage, *own(k)[2:]])) for k in range(6)] + [(50, "\n".join(own(50))), (51, None), (52, ""), (53, "one\none\none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit("clash"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == len(rows) and got[0].body == "clash"
    assert got[0].text == rows[0][1] and got[50].text == rows[6][1] and got[51].text is None and got[52].text == "" and got[53].text == "one\none\none"
    for k in range(1, 6):
        assert got[k].text == "\n".join(own(k)) and got[k].removed_lines == 2


def test_line_dedup_beside_null_ids(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, passage), (1, f"one\n{passage}"), (2, f"two\n{passage}")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left == {None: passage, 1: f"one\n{passage}", 2: "two"}


def test_line_dedup_of_short_lines(spark):
    """A repeated passage of short lines among short lines goes whole, wherever the cuts fall."""
    rows, own = [], {}
    for shape, (n, words) in enumerate([(5, 12), (7, 8), (4, 15), (3, 20), (13, 4), (17, 3)]):
        for trial in range(6):
            passage = [" ".join(f"s{shape}t{trial}p{i}w{j}" for j in range(words)) for i in range(n)]
            for copy in range(2):
                k = len(rows)
                own[k] = [" ".join(f"d{k}x{i}w{j}" for j in range(words)) for i in range(8)]
                rows.append((k, "\n".join([*own[k][:4], *passage, *own[k][4:]])))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = {r.doc_id: r.text for r in got}
    for k, text in rows:
        assert left[k] == ("\n".join(own[k]) if k % 2 else text)


def test_decontamination(spark, small):
    item = "when the quick auditor verified seven sealed ledgers before noon nobody expected the hidden balance to reveal. The answer was forty silver coins"
    noise = lambda k, n: " ".join(f"z{k}y{i}" for i in range(n))
    w = item.split()
    loose = " ".join(x for i, x in enumerate(w) if i % 6 != 1)
    rows = [(1, f"{noise(1, 90)} {item} {noise(2, 70)}"), (2, noise(3, 200)), (3, f"{noise(4, 33)} {loose} {noise(5, 40)}"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "another unrelated benchmark question about purple rivers and distant mountains today"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(1, 7), (3, 7)} and got[1, 7] == "copy"
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.lcs(list("abcbdab"), list("bdcaba")) == 4


def test_decontamination_of_edited_items(spark):
    """Items whose rarest quarter of words is replaced are copies still, for all that is left of them is common."""
    common = [f"c{i}" for i in range(60)]
    items = [(k, [common[(7 * k + i) % 60] if i % 4 else f"rare{k}x{i}" for i in range(24)]) for k in range(6)]
    draw = np.random.default_rng(3)
    filler = lambda k: [f"f{k}w{i}" if i % 3 else common[j] for i, j in enumerate(draw.integers(0, 60, 90))]
    edited = lambda ws: [f"new{w}" if w.startswith("rare") else w for w in ws]
    rows = [(k, [*filler(k)[:40], *edited(ws), *filler(k)[40:]]) for k, ws in items] + [(100 + k, filler(k)) for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontamination.leaks(docs, bench).collect()}
    assert {(k, k, "copy") for k, _ in items} <= got and all(d < 100 for d, _, _ in got)


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_quality(request, which):
    df = request.getfixturevalue(which)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for d, t in texts(df).items():
        t, r = t or "", got[d]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen, cover = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                cover.update(range(i, i + 8))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_url_filter(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{small}/pages.parquet')")
    want = sorted(con.sql("SELECT page_id, host, path, rule, verdict, listed FROM (" + registry.oracle_sql()["op8_url_filter"] + ")").fetchall())
    assert sorted(map(tuple, url_filter.op8_url_filter(spark, small).collect())) == want
    odd = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.ORG"), (4, "x://EXAMPLE.org/es/?q"), (5, "http://b.com/fr/#x")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(odd, spark.createDataFrame([("a.org",)], "h string")).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.org", "", None, "block"),
        4: ("example.org", "/es/", "example.org/es/", "block"), 5: ("b.com", "/fr/", "com/fr/", "allow"),
    }


@pytest.mark.parametrize("sizes", [{}, {"keys_per_shard": 50, "broadcast_bytes": 0}])
def test_cascade_is_exact(spark, sizes):
    keys = spark.range(2000).select(F.concat(F.lit("h"), F.col("id") % 700).alias("k"))
    listed = spark.range(0, 700, 3).select(F.concat(F.lit("h"), F.col("id")).alias("host"))
    for r in url_filter.with_listed(keys, F.col("k"), listed, **sizes).collect():
        assert r.listed == (int(r.k[1:]) % 3 == 0)


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    common = ["the", "of", "and", "house", "river", "stone", "walks", "under", "bright", "table", "window", "garden", "letter", "music"]
    make = lambda toxic: " ".join("grumblefoot" if toxic and rng.random() < 0.08 else str(w) for w in rng.choice(common, 80))
    rows = [(make(y), y, bool(i % 2)) for i in range(160) for y in (0, 1)]
    model = toxicity.fit(rows)
    df = spark.createDataFrame([(i, make(i % 2)) for i in range(60)] + [(100, None), (101, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(60)) >= 55
    assert got[100].score == got[101].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    assert got[100].held_out == (zlib.crc32(b"100") % 5 == 0)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id=main><h1>A  title &amp; more</h1><p>First <b>bold</b> paragraph, with a comma. It has enough text to matter here.
<p>Second&nbsp;one<br>goes on, and on; it also has some length to it, as articles do.</div>
<aside>Side text that is not wanted</aside><div class="comments"><p>Nice article, I liked it a lot, thanks for all.</div>
<form><p>Your name</p></form><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == (
        "A title & more\nFirst bold paragraph, with a comma. It has enough text to matter here.\n"
        "Second one goes on, and on; it also has some length to it, as articles do."
    )
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "</p></b>")][:2] == ["", ""]


def test_html_nested():
    """A title, a lead and a last section beside the element that holds most of the text are kept."""
    long, lead = "A sentence of the article, with a comma. " * 20, "The lead says, in short, what follows below here."
    got = html_text.main_text(f"<body><main><h1>Title</h1><p>{lead}</p><div class=content><p>{long}</p></div></main></body>")
    assert got == f"Title\n{lead}\n{long.strip()}"
    last = "A last section, also of the article, with some text. " * 3
    got = html_text.main_text(f"<body><div><h1>Title</h1><section><p>{long}</p></section><section><p>{last}</p></section></div></body>")
    assert got == f"Title\n{long.strip()}\n{last.strip()}"


def test_html_marks():
    """The main text is main text whatever else its names say; ambiguous names within it don't switch parts off."""
    text = ("A sentence of the article, with a comma. " * 20).strip()
    for names in ('class="content has-sidebar"', 'class="entry-content no-sidebar"', 'id=main class="with-sidebar"', 'class="sidebar-left" id=main'):
        assert html_text.main_text(f"<body><div {names}><p>{text}</p></div></body>") == text
    for part in ("<section id=discussion><p>{}</p></section>", '<div class="related-work"><p>{}</p></div>', "<p class=notice>{}</p>"):
        assert html_text.main_text(f"<body><article><section><div><p>{text}</p></div></section>{part.format(text)}</article></body>") == f"{text}\n{text}"
    assert html_text.main_text(f'<body><div id=main><p>{text}</p></div><div class="sidebar container"><p>{text}</p></div></body>') == text


def test_html_pages(spark, small):
    for r in html_text.extract(table(spark, small, "pages")).join(table(spark, small, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1].replace("<br>", " ")
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_empty_tables(spark):
    docs = empty(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    hosts = spark.createDataFrame([], "h string")
    for df in (
        sharding.shard_by_bytes(docs), packing.pack(docs), minhash.near_duplicates(docs), line_dedup.dedup_lines(docs), quality.judge(docs),
        toxicity.score(docs, toxicity.Model()), html_text.extract(pages), url_filter.filter_urls(pages, hosts),
        token_files.read_documents(spark, token_files.write_token_files(docs, shared_dir(spark, "t"))),
    ):
        assert df.count() == 0


def test_minhash_null_ids_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (7, None), (7, ""), (8, "a b c d e f g")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 3, None, True), (7, 0, 7, True), (7, 0, 7, True), (8, 4, 8, True)], key=str)


def test_minhash_hot_groups(spark, monkeypatch):
    """Groups that many rows share are dealt to several tasks, with the same result."""
    from docscope.llm import common

    monkeypatch.setattr(common, "SPREAD", 3)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(50)]
    rows = [(k, " ".join(base)) for k in range(20)]
    rows += [(100 + k, " ".join([*base[:47], f"x{k}", f"y{k}", f"z{k}"])) for k in range(30)]
    rows += [(200 + k, " ".join([*base[:25], *(f"u{k // 2}v{i}" for i in range(25))])) for k in range(30)]
    df = spark.createDataFrame([*rows, (300, None), (301, None), (302, "")], "doc_id long, text string")
    label = brute_components(shingle_sets(df))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == label


def test_near_and_far_tokenizers(spark, tmp_path):
    """A tokenizer other than the one of the fast path gets whole texts by the library; ids too large for the files raise."""
    import public_tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    code = tokens.encoder(other)
    assert not code.fast and tokens.encoder().fast
    for t in ["Don't  stop\n now", "É x²", " a b"]:
        assert code.encode(t) == code.library(t)
    with pytest.raises(ValueError):
        token_files.write_token_files(empty(spark), f"file://{tmp_path}/t", dtype="uint8")


def test_shortest_pack_first():
    assert packing.pack_histogram({3000: 1, 2500: 1, 1000: 1}) == [((3000,), 1), ((2500, 1000), 1)]
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 60, rng.integers(1, 40)).tolist()
        packs = []  # one length at a time, each to the shortest pack
        for n in sorted(lengths, reverse=True):
            low = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
            if low is None or sum(packs[low]) + n > 60:
                packs.append([n])
            else:
                packs[low].append(n)
        got = sorted(sum(p) for p, n in packing.pack_histogram(dict(collections.Counter(lengths)), 60) for _ in range(n))
        assert got == sorted(map(sum, packs))
    lengths = np.minimum(4096, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    packs = sum(n for _, n in packing.pack_histogram(dict(collections.Counter(lengths.tolist()))))
    assert lengths.sum() / (4096 * packs) > 0.99


def brute_removed(rows, long_words=line_dedup.LONG_WORDS):
    """Lines that go from each document: every chunk equal to an earlier one, grown over equal lines on both sides."""
    first, gone, lines = {}, collections.defaultdict(set), {d: (t or "").split("\n") for d, t in rows}
    found = sorted((d, s, n) for d, ls in lines.items() for s, n in line_dedup.chunks([x.encode() for x in ls], long_words))
    for d, s, n in found:
        first.setdefault(tuple(lines[d][s : s + n]), (d, s))
    for d, s, n in found:
        d0, s0 = first[tuple(lines[d][s : s + n])]
        if (d0, s0) != (d, s):
            a, b = lines[d], lines[d0]
            words = [len(x.split()) for x in a]
            up, down = line_dedup._reach(words, s - 1, -1, long_words), line_dedup._reach(words, s + n, 1, long_words)
            k = 0
            while k < min(up, s0) and a[s - k - 1] == b[s0 - k - 1]:
                k += 1
            m = 0
            while m < down and s0 + n + m < len(b) and a[s + n + m] == b[s0 + n + m]:
                m += 1
            gone[d] |= set(range(s - k, s + n + m))
    return {d: "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d, t in rows if t is not None}


def test_line_dedup_brute_force(spark, small, monkeypatch):
    """Against a dictionary of all chunks, with keys dealt to many tasks; extra columns of any name, empty texts and a long one."""
    from docscope.llm import common

    monkeypatch.setattr(common, "SPREAD", 2)
    rows = sorted(texts(table(spark, small, "documents")).items()) + [(10_001, None), (10_002, ""), (10_003, LONG), (10_004, f"{LONG}\nmore")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("spans", F.lit(7))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    want = brute_removed(rows)
    assert {d: r.text for d, r in got.items() if r.text is not None} == want and got[10_001].text is None
    assert got[10_004].text == "more" and all(r.spans == 7 for r in got.values())
    assert sum(t != want.get(d) for d, t in rows if t is not None) > 20


def planted(texts_, items, share, seed):
    """Documents with an item each, of which a share of the words is replaced by words of other documents."""
    rng = np.random.default_rng(seed)
    pool = [w for t in texts_[:100] for w in (t or "").split()]
    out = []
    for k, t in items:
        words = [pool[rng.integers(len(pool))] if rng.random() < share else w for w in t.split()]
        around = (texts_[rng.integers(len(texts_))] or "").split()[:300]
        at = int(rng.integers(len(around) + 1))
        out.append((k, " ".join([*around[:at], *words, *around[at:]])))
    return out


def test_decontamination_against_brute_force(spark, small):
    """Of what comparing every passage with every item finds, and of planted paraphrases, at least 0.9 is found; nothing else is."""
    own = [t for _, t in sorted(texts(table(spark, small, "documents")).items())]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    rows, shares = list(enumerate(own)), {}
    for n, share in enumerate((0.0, 0.2, 0.3)):
        for k, t in planted(own, items, share, n):
            shares[len(rows)] = share, k
            rows.append((len(rows), t))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, table(spark, small, "benchmark")).collect()}
    weight = np.ones(decontamination.BUCKETS)
    import pyarrow as pa

    held = decontamination.Sketch(0)
    for _, _, h, bounds in decontamination.words_of(pa.array([t for _, t in rows])):
        held.add(h, bounds)
    weight = decontamination.weights(held.df, held.n)
    known, want = [decontamination.Item(k, t, weight) for k, t in items], set()
    for first, _, h, bounds in decontamination.words_of(pa.array([t for _, t in rows])):
        for i in range(len(bounds) - 1):
            ws = h[bounds[i] : bounds[i + 1]].tolist()
            for p in range(max(1, -(-len(ws) // 32) - 1) if ws else 0):
                for item in known:
                    around = len(item.words)
                    if item.match(ws[max(0, p * 32 - around) : (p + 2) * 32 + around])[0]:
                        want.add((first + i, item.id))
    assert len(got & want) >= 0.9 * len(want) and got <= want
    for share in (0.0, 0.2, 0.3):
        mine = [(d, k) for d, (s, k) in shares.items() if s == share]
        assert sum(x in got for x in mine) >= 0.9 * len(mine), share
    assert decontamination.leaks(empty(spark), table(spark, small, "benchmark")).count() == 0


def test_html_by_ratios(spark, small):
    """Without an article element the ratios find the same text, and without the ratios it is not found."""
    same = other = 0
    pages = [r.html for r in table(spark, small, "pages").select("html").collect()]
    for page in pages:
        bare = re.sub(r"<(/?)article>", r"<\1div>", page)
        want = html_text.main_text(page)
        same += html_text.main_text(bare) == want
        other += html_text.main_text(bare, 0.0) != want
    assert same == len(pages) and other > 0.9 * len(pages)
    text = ("A sentence of the article, with a comma. " * 20).strip()
    assert html_text.main_text(f'<body><div class="side-by-side"><p>{text}</p></div></body>') == text
    lead = f"<body><div><h1>Title</h1><p>The lead says, in short, what follows.</p><div class=content><p>{text}</p><ul><li>one<li>two</ul></div></div></body>"
    assert html_text.main_text(lead) == f"Title\nThe lead says, in short, what follows.\n{text}\none\ntwo"
    rows = [(1, "u", None), (None, None, ""), (None, None, ""), (3, "u", f"<p>{text * 300}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.n_chars) for r in html_text.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (None, 0), (None, 0), (3, len(text) * 300)], key=str)


ODD = [(None, "same text of a row without id " * 9, "en"), (None, "same text of a row without id " * 9, "en"), (5, LONG, "en"), (5, LONG, "en"), (5, None, None), (6, "", "xx")]


def test_null_ids_and_repeated_rows(spark):
    """Rows without id, repeated rows and columns with the operators' own names: every row comes back once."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    for c in ("shard", "row", "part", "size", "n_words", "kept", "held_out", "score", "length", "rank", "h1", "listed", "spans", "words"):
        df = df.withColumn(c, F.lit("clash"))
    ids = sorted(str(d) for d, *_ in ODD)
    crc = lambda t: zlib.crc32((t or "").encode())
    got = sharding.shard_by_bytes(df, 3).collect()
    assert sorted((str(r.doc_id), r.text_crc32) for r in got) == sorted((str(d), crc(t)) for d, t, _ in ODD)
    for frame in (quality.judge(df), toxicity.score(df, toxicity.Model()), minhash.near_duplicates(df), line_dedup.dedup_lines(df)):
        rows = frame.collect()
        assert sorted(str(r.doc_id) for r in rows) == ids
        if "kept" in frame.columns and frame.columns[1] != "text":
            assert all(r.kept in (True, False) for r in rows)
    pieces = packing.pack(df).collect()
    assert sum(r.length for r in pieces) == sum(len(true_ids(tokens.encoder().tokenizer, t)) for _, t, _ in ODD)
    shards = token_files.write_token_files(df, shared_dir(spark, "t"))
    assert sorted(str(r.doc_id) for r in token_files.read_documents(spark, shards).collect()) == ids
    pages = df.selectExpr("doc_id page_id", "concat('http://h', length(text), '.com/') url", "listed", "h1")
    urls = url_filter.with_listed(pages, F.col("url"), spark.createDataFrame([("http://h0.com/",), (None,)], "h string")).collect()
    assert sorted(r.listed for r in urls) == [False] * 5 + [True] and urls[0].h1 == "clash"
