"""The dealt methods against their definitions, the libraries and independent data."""

import random
import re
import struct
import time

import duckdb
import numpy as np
import pytest

from sparkwright.llm import html_text, mixing, pieces, quality, queries, secrets, tokens, topk, urls
from sparkwright.llm.wordhash import slice_hashes


# Pieces ---------------------------------------------------------------------------


def _field(number, value):
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def unigram_model(bytes_on, charsmap=b"", strip=1):
    """A unigram model file made by hand."""
    rng = random.Random(1)
    words = ["▁", "a", "b", "c", "d", "e", "é", "▁a", "▁b", "ab", "abc", "bc", "▁abc", "de", "cde", "▁▁", "!", "1", "ée", "▁de", "a▁b", "fi", "f", "i"]
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 * bytes_on)]
    pieces_ += [(w, -rng.random() * 9 - 0.5, 1) for w in words]
    out = b"".join(_field(1, _field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + _field(3, t)) for p, s, t in pieces_)
    out += _field(2, _field(3, 1) + _field(35, bytes_on))
    return out + _field(3, (_field(2, charsmap) if charsmap else b"") + _field(3, 1) + _field(4, strip) + _field(5, 1))


@pytest.mark.parametrize("bytes_on", [0, 1])
@pytest.mark.parametrize("strip", [0, 1])
def test_unigram_models_equal_the_library(bytes_on, strip):
    import sentencepiece

    charsmap = b""
    if strip:
        spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        charsmap = dict(pieces._fields(dict(pieces._fields(spec))[3]))[2]
    data = unigram_model(bytes_on, charsmap, strip)
    wfst, reference = pieces.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice([*"abcdeé  !1zf", "ab", "日", "ﬁ", "Ａ", "\t", "é", "　"]) for _ in range(rng.randint(0, 25)))
        ids = wfst.encode(t).tolist()
        assert ids == reference.encode(t), repr(t)
        assert wfst.decode(ids) == reference.decode(ids), repr(t)


def test_long_words_and_their_paths():
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    wfst, reference = pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    for t in ("x" * 5000, "".join(rng.choice("abcdefgh") for _ in range(4000)), "é日" * 700, " " * 333, "▁a" * 50, "a\0b", "-" * 1000):
        assert wfst.encode(t).tolist() == reference.encode(t)


def test_weights_of_the_acceptor():
    wfst = pieces.model(queries.tokenizer_file("piece_bpe_32k.model"))
    at = {p: k for k, p in enumerate(wfst.symbols)}
    pairs = [(" the", " and"), ("t", "h"), (" t", "he"), ("a", "a")]
    a, b = (np.array([at[p[k]] for p in pairs]) for k in (0, 1))
    assert wfst._alone(a, b, np.full(len(a), pieces.NEVER)).tolist() == [True, False, False, False]


# Tokens ---------------------------------------------------------------------------


def test_tokens_of_any_white_space_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    reference, encoder = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    rng = random.Random(4)
    parts = [*"abcde ABC   \n\t.,;:!?0123456789éßñ日本語😀'\"()-_/ 　 \x85\x1c\r", "the", " and", "'s", "'ll", "<|endoftext|>", "'re "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["a" * 100_000]
    for _ in range(2):  # once more, from memory
        for t, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, encoder.dtype).tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)


# Words ----------------------------------------------------------------------------


def test_words_that_a_polynomial_confuses_differ():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = (bytes(97 + (x ^ f) for x in bits) for f in (0, 1))
    for size in (1024, 512, 256):
        data = np.frombuffer(a[:size] + b[:size] + a[:size], np.uint8)
        h = slice_hashes(data, np.array([0, size, 2 * size]), np.array([size, 2 * size, 3 * size]))
        assert h[0] != h[1] and h[0] == h[2]
    data = np.frombuffer(b"abcdefghij", np.uint8)
    assert len(set(slice_hashes(data, np.arange(10), np.full(10, 10)).tolist())) == 10


# Top-k ----------------------------------------------------------------------------


def test_trees_prune():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32)) * 3
    x = np.floor((centres[rng.integers(0, 40, 4096)] + rng.normal(size=(4096, 32)) * 0.1) * 256).astype(np.int64)
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 50)
    search = topk.Search(x[asked], ids[asked], x[:0], ids[:0], 5)
    tree = topk.cover_tree(x[asked])
    for lo in range(0, len(x), 2048):  # kth scores carry over
        search.against(x[lo : lo + 2048], ids[lo : lo + 2048])
        search.run(tree, topk.cover_tree(x[lo : lo + 2048]))
    assert search.compared < 0.1 * len(asked) * len(x), search.compared
    for r, q in enumerate(asked):
        s = x @ x[q]
        s[q] = -(1 << 62)
        assert search.found[r].tolist() == np.lexsort((ids, -s))[:5].tolist()


def test_cover_tree_separates():
    x = np.random.default_rng(5).normal(size=(700, 4))
    todo = [topk.cover_tree(x)]
    while todo:
        node = todo.pop()
        for k, child in enumerate(node.children):
            assert child.radius <= node.radius / 2
            assert all(np.sqrt(((child.centre - other.centre) ** 2).sum()) > node.radius / 2 for other in node.children[:k])
        todo += node.children


def test_hot_vectors_and_huge_components(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1, 3001)] + [(5000, [1e30, 1e30]), (5050, [1e30, -1e30]), (5100, [3e38, 3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df).collect()}
    most = (1 << 63) - 1
    assert [got[100, r][0] for r in range(1, 6)] == [5000, 5100, 1, 2, 3]
    assert got[5000, 1] == (5100, most) and got[5050, 1][0] == 5000
    assert len(got) == 5 * (60 + 3)


def test_top_k_sql_agrees(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES["op7_exact_top_k"]).fetchall())
    assert sorted(map(tuple, queries.op7_exact_top_k(spark, data).collect())) == want


# URLs -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def url_model(spark):
    return urls.fit(urls.labelled_urls(spark))


def test_trees_ask_for_every_dealt_feature(url_model):
    used = {f for f, n in url_model.splits.items() if n}
    assert used >= {"length", "depth", "digits", "entropy", "parameters", "suffix_rate", "hyphens"}, url_model.splits
    rates = url_model.rates
    assert max(rates[s] for s in ("com", "org", "net", "edu")) < 0.5 < min(rates[s] for s in ("top", "xyz", "click"))


def test_urls_of_another_make(spark, url_model):
    """Pronounceable names from another alphabet, paths of real sites, against strung, random, deep and doubtful ones."""
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    clean = [lambda: f"https://www.{name()}.com/{name()}/{name()}", lambda: f"http://{name()}.org/", lambda: f"https://{name()}.{name()}.net/articles/{rng.randint(1, 999)}", lambda: f"https://{name()}.edu/~{name()}/index.html", lambda: f"https://{name()}.de/{name()}?q={name()}"]
    spam = [
        lambda: f"http://{name()}-{name()}-{name()}.info/{name()}", lambda: "http://" + "".join(rng.choice("abcdefghkqxz0123456789") for _ in range(18)) + f".xyz/{name()}",
        lambda: f"http://{name()}.top/" + "/".join(str(rng.randint(1, 9999)) for _ in range(7)) + "?" + "&".join(f"{c}={rng.randint(1, 999999)}" for c in "abcdef"), lambda: f"http://{name()}{rng.randint(100, 999)}.click/{name()}",
    ]
    rows = [(k, rng.choice((clean, spam)[k % 2])()) for k in range(600)]
    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [], url_model).collect()
    right = sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in judged)
    assert right >= 0.9 * len(rows), right
    probes = {"http://xk7q9zzt4-8831-aa-11-22-33.example.xyz/a/b/c/d/e/f/9999?a=1&b=2&c=3&d=4&e=5&f=6": "block", "http://game.org/": "allow", "http://winner.edu/about": "allow"}
    table = spark.createDataFrame(list(enumerate(probes)), "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(table, [], url_model).orderBy("page_id").collect()] == list(probes.values())


# Pages ----------------------------------------------------------------------------


def test_inline_adverts_and_unquoted_attributes():
    text = lambda page: html_text.main_text(page, html_text.model())
    more = "<p>another sentence of the article that goes on for some words</p>"
    assert "BUY" not in text(f"<body><div><p>More <span class=advert>BUY NOW</span> text of the article in a line</p>{more}</div></body>")
    page = f'<body><article><p>See <a href=/x/>the link</a> and <span class="text">this part</span>.</p><div class=wrap/><p>within</p></div>{more}</article></body>'
    assert text(page).startswith("See the link and this part.\nwithin\n")
    assert text(f"<body><article><p>before <svg viewBox='0 0 1 1'/> after the picture</p>{more}</article></body>").startswith("before after the picture")


def test_stray_tags_take_linear_time():
    def seconds(page):
        t = time.process_time()
        html_text.parse(page)
        return time.process_time() - t

    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<p><td>" + "<b>" * n + "<hr>" * n, lambda n: "<table>" + "<b>" * n + "<tr>" * n):
        assert seconds(make(16_000)) < 10 * seconds(make(4_000)) + 0.2


def test_pages_of_another_make():
    """Pages written by hand, in the manner of common site builders."""
    article = ["A storm crossed the northern coast on Monday and left thousands of homes without power.", "Crews worked through the night to clear the roads, and schools stayed shut.", "More rain is expected before the weekend, forecasters said."]
    ps = "".join(f"<p>{p}</p>" for p in article)
    pages = [
        f'<html><body class="home"><div id="masthead"><a href="/">Daily</a></div><div class="site-nav"><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></div><div class="post-content">{ps}</div><div class="sidebar-right"><h3>Trending</h3><a href="/c">Ten tips</a></div><div id="footer">Copyright</div></body></html>',
        f'<body><header><nav><a href="/">Home</a> <a href="/about">About</a></nav></header><main><article class="entry"><div class="c-body">{ps}</div><div class="share-bar"><a href="#">Share</a> <a href="#">Tweet</a></div></article><section id="comments"><div class="comment"><p>I saw that storm too, it was loud.</p></div></section></main><footer><p>All rights reserved</p></footer></body>',
        f'<body><div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div><div class="container"><div class="row"><div class="col">{ps}</div><aside><form><label>Search</label><input name="q"></form></aside></div></div></body>',
    ]
    for page in pages:
        assert html_text.main_text(page, html_text.model()) == "\n".join(article)


# Quality --------------------------------------------------------------------------


def test_probabilities_are_calibrated(spark):
    """Labels are drawn with a known chance for each text; the probabilities must say it."""
    rng = random.Random(8)
    docs, labels, chance = [], [], {}
    for i in range(2400):
        k = rng.randint(0, 10)
        words = [rng.choice(["calm", "river", "stone", "meadow"]) for _ in range(k)] + [rng.choice(["click", "prize", "cash", "winner"]) for _ in range(10 - k)]
        rng.shuffle(words)
        docs.append((i, " ".join(words + [f"n{rng.randint(0, 30)}" for _ in range(5)])))
        chance[i] = 0.05 + 0.9 * k / 10
        labels.append((i, int(rng.random() < chance[i])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(table, spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, quality int"))
    got = {r["doc_id"]: r["probability"] for r in quality.judge(table.where("doc_id % 3 = 0"), model).collect()}
    y = dict(labels)
    brier = np.mean([(p - y[i]) ** 2 for i, p in got.items()])
    best = np.mean([(chance[i] - y[i]) ** 2 for i in got])
    assert brier < best + 0.03, (brier, best)
    for lo in np.arange(0, 1, 0.25):
        at = [i for i, p in got.items() if lo <= p < lo + 0.25]
        if len(at) >= 40:
            assert abs(np.mean([got[i] for i in at]) - np.mean([y[i] for i in at])) < 0.15, lo


def test_features_are_words_and_characters():
    from sparkwright.llm.wordhash import Words

    def features(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return quality._features(Words(raw, np.array([0, len(raw)])))[0]

    a, b = features("red fox ran"), features("ran fox red")
    assert (a != b).any() and np.count_nonzero(features("one two")[: quality.WIDTH]) == 3
    assert np.count_nonzero(features("日本語")[quality.WIDTH :]) == 1 and np.count_nonzero(features("aéb日")[quality.WIDTH :]) == 2


# Secrets --------------------------------------------------------------------------


def test_no_value_inside_a_base_span_and_whole_identifiers():
    text = "token=0123456789abcdef0123456789.Xk3v9Qm2Tz7Lp4Wc8Rn1Aa user: alice host: db.example.com"
    base = secrets.base_spans(text)
    cover = [s for s in base if s[2] == "assign"][0]
    assert not [s for s in secrets.linked_spans(text, base) if s[2] == "value" and s[0] >= cover[0] and s[1] <= cover[1]]
    got = secrets.redacted("user: " + "x" * 100 + " host: db.example.com password: hunter2!x")
    assert got == "[secret] host: db.example.com [secret]"


# Mixing ---------------------------------------------------------------------------


def test_shards_get_their_seats_by_highest_quotients():
    rng = random.Random(1)
    for _ in range(800):
        shard, blocks, most = rng.choice([2, 3, 4, 7]), rng.randint(1, 40), rng.choice([1, 2])
        seats = rng.randint(0, most * blocks)
        full, short = divmod(blocks, shard)
        votes = [shard] * full + [short] * bool(short)
        each, extra, last = mixing.spread(seats, blocks, most, shard)
        got = [each + (i < extra) for i in range(full)] + [last] * bool(short)
        want = [0] * len(votes)
        for _ in range(seats):
            free = [i for i in range(len(votes)) if want[i] < most * votes[i]]
            want[max(free, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert got == want


def test_taken_words_by_brute_force(spark):
    """Every word's place on the axis, its block and the block's times, one by one."""
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 17, 90]))), rng.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs, block=None).collect()}
    sizes = {i: len(re.findall(r"\S+", t)) for i, t, _ in rows}
    for source, weight in (("a", 3), ("b", 1), (None, 2)):
        of = [i for i, _, s in rows if s == source]
        total = sum(sizes[i] for i in of)
        taken = sum(got[i]["taken"] for i in of)
        target = got[of[0]]["target"]
        assert all(got[i]["source_size"] == total and got[i]["taken"] <= 2 * sizes[i] for i in of)
        assert target <= 2 * total and abs(taken - target) <= 2 + 2 * target / mixing.PART, (source, weight, taken, target)


def test_shards_equal_their_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sparkwright.llm import queries

    rows = [(i, "naïve " * (i % 7) + str(i % 5)) for i in range(150)] + [(3, "again"), (3, "again"), (None, "no id"), (7, None), (8, "")]
    for count in (len(rows), 1, 0):
        pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows[:count]], pa.int64()), "text": pa.array([r[1] for r in rows[:count]], pa.string())}), tmp_path / "documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
        want = con.execute(queries.ORACLES["op5_sharding"]).fetchall()
        found = [tuple(r) for r in queries.op5_sharding(spark, str(tmp_path)).collect()]
        assert len(want) == count and sorted(found, key=repr) == sorted(want, key=repr)
