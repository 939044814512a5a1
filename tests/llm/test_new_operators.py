"""Operators 11 to 13 against brute-force versions, with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessaria.llm import alignment, url_filters, whitening

# ---- 11: alignment ----------------------------------------------------------------------------------------------------


def brute_align(texts):
    """Whole texts, token by token: per text its numbers, its groups as text and its links."""
    a_tok = Tokenizer.from_file(alignment.BYTE_BPE)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {}, 0
    for x in range(256):
        chars[chr(x) if x in printable else chr(256 + extra)] = x
        extra += x not in printable
    out, links = [], []
    for t in texts:
        groups = []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            a_raw = [bytes(chars[c] for c in a_tok.id_to_token(i)) for i in a]
            b_raw = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + t).encode():
                i = j = end_a = end_b = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if end_a <= end_b and i < len(a):
                        end_a += len(a_raw[i])
                        group[0].append(a[i])
                        i += 1
                    else:
                        end_b += len(b_raw[j])
                        group[1].append(b[j])
                        j += 1
                    if end_a == end_b:
                        groups.append(group)
                        group = ([], [])
        out.append(groups)
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
    count = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    rows = []
    for groups, c in zip(out, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]),
                     sum(n * count[p] for p, n in c.items()), text, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


def aligned_texts(n=140):
    rng = random.Random(11)
    pool = [*"abcdeé \n\t\r\x1c\xa0　—'’s.,!?0123中文字🙂<>|=-{}();", "the ", " of", "\n\n", "   ", "<|endoftext|>", "<s>", "don't", "    x", "İ", ");\r\n", ",\r", "\r{", "x" * 70]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 90))) for _ in range(n)]
    texts += ["The vale of the mill, the river and the vale."] * 6 + ["a ▁ b", "▁", None, "", " ", "\n", "  \n ", "=" * 3000, "aaaaaaa" * 400, "中文字" * 300, "<0x41> <unk>"]
    return [*texts, " ".join(rng.choice(["the", "mill", "river,", "übung"]) + str(rng.randrange(50)) for _ in range(20000)), *texts[:4]]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")


@pytest.mark.parametrize("block_chars", [300, alignment.BLOCK_CHARS])
def test_alignment(spark, monkeypatch, block_chars):
    texts = aligned_texts()
    docs = spark.createDataFrame([(i // 2, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, block string, at long").repartition(3)
    got = alignment.align_tokens(docs, carry=("doc_id", "block", "at"), block_chars=block_chars).collect()
    assert {tuple(r[c] for c in ("doc_id", "block_carried", "at_carried", *ALIGNED)) for r in got} == {(i // 2, "x", i, *want) for i, want in enumerate(brute_align(texts))}
    assert len(got) == len(texts)


def test_alignment_remembers_and_forgets(monkeypatch):
    """Segments that are forgotten, long, or altered give what whole texts give; so do tokenizers that are never cut up."""
    monkeypatch.setattr(alignment, "KNOWN", 20)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    texts, known = aligned_texts(60), alignment.Segments(alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE))
    want = brute_align(texts)
    for apart in (True, False):
        known.tok.apart = apart
        for t, w in zip(texts, want, strict=True):
            if t:
                cut_up = known.tok.segment.findall(" " + t)
                if apart:
                    known.learn(cut_up)
                at = known.of(" " + t, cut_up)
                total = known.sizes[at].sum(axis=0).tolist()
                assert (*total, ";".join(known.text[i] for i in at) if total[0] else "") == (*w[:4], w[6])
                pairs, times = known.links(*np.unique(at, return_counts=True))
                assert times.sum() == w[3] and len(set(pairs.tolist())) == len(pairs)
                known.end_block()
    assert len(known.text) <= 40


def test_alignment_of_nothing(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    r = alignment.align_tokens(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert r["n_a"] == r["n_links"] == r["count_sum"] == 0 and r["groups_sha256"] == ""


# ---- 12: whitening ----------------------------------------------------------------------------------------------------


def brute_whitening(rows, most=32):
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    w = np.array(y, float) / n @ vectors[:, order] / np.sqrt(values[order])
    return [k for k, _ in kept], n, [sum(c * c for c in v) for v in y], values[order] / np.trace(cov), w


def vectors(n=300, d=9, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 20
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(n + i, rows[7][1]) for i in range(90)] + [(7, rows[3][1])]
    rows += [(1000, None), (1001, [None] + [1.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] + [0.0] * (d - 1))]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening(spark, scale):
    rows = [(k, v and [c and c * scale for c in v]) for k, v in vectors()]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "vec_id long, embedding array<float>, component int, n string").repartition(4)
    rows = [(k, v and [None if c is None else float(np.float32(c)) for c in v]) for k, v in rows]
    ids, n, deviation, explained, w = brute_whitening(rows)
    got = whitening.whiten(df, carry=("vec_id", "component", "n")).collect()
    assert len(got) == len(ids) * 9 and {(r["component_carried"], r["n_carried"]) for r in got} == {(5, "z")}
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 10))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter((k, x if x < 2**63 else None) for k, x in zip(ids, deviation, strict=True))
    assert np.allclose([e for _, e in sorted({(r["component"], r["explained"]) for r in got})], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    # One sign for a component in all rows, then the same numbers; equal ids are told apart by their numbers.
    for c in range(9):
        mine, theirs = sorted((r["vec_id"], r["whitened"]) for r in got if r["component"] == c + 1), sorted(zip(ids, w[:, c].tolist(), strict=True))
        other = sorted(zip(ids, (-w[:, c]).tolist(), strict=True))
        assert any(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(mine, x, strict=True)) for x in (theirs, other))


def test_polarised_covariance(spark):
    """The assembled matrix is the exact covariance, whatever the mean."""
    rows = [(i, [c + 1e6 for c in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(200, 6)).tolist())]
    f = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    y = x * len(x) - x.sum(axis=0)
    assert f.covariance.tolist() == [[int((y[:, i] * y[:, j]).sum()) / len(x) ** 3 for j in range(6)] for i in range(6)]


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [1.5, -2.0]) for i in range(5)], schema)).collect()
    assert len(same) == 10 and {(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in same} == {(0.0, 0, 0.0, 0.0)}
    # A vector of another length is left out; with two vectors one component varies.
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [5.0, 1.0, 3.0]), (3, [1.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in got} == {(v, c, 1.0 if c == 1 else 0.0) for v in (1, 2) for c in (1, 2, 3)}
    assert whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [-3e38])], schema)).count() == 2


# ---- 13: URL filters --------------------------------------------------------------------------------------------------


def brute_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut_at = lambda x, ends: x[: min([x.find(e) for e in ends if e in x], default=len(x))]
    host = cut_at(rest, "/?#")
    path = cut_at(rest[len(host):], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def urls():
    rng = random.Random(13)
    out = [None, "", "example.org/es/x", "://", "http://", "http://org", "http://ORG/", "https://a.org?x=/es/", "https://example.org/es/#t", "https://x.EXAMPLE.org/es", "https://notexample.org/en/1",
           "https://example.org/en/12", "https://example.org/EN/1", "https://example.org:80/es/", "ftp://u@com/de/", "https://a.com/de/#/fr/", "https://a.com//fr/", "https://com./fr/", "https://a..com/fr/",
           "https://é.org/ü/x", "https://a.com/fr/\nb", "x://y://org/", "https://org/" + "a/" * 5000, "https://" + "a." * 300 + "org/"]
    for _ in range(400):
        host = ".".join(rng.choice(["a", "b", "example", "Com", "org", "net"]) for _ in range(rng.randrange(1, 5)))
        out.append(f"https://{host}/{rng.choice(['', 'fr', 'de', 'es', 'en'])}{rng.choice(['', '/', '/1', '/12'])}{rng.choice(['', '?q=/de/', '#x'])}")
    return out + ["https://hot.com/fr/1"] * 200


def test_url_filters(spark, tmp_path):
    rows = [(i // 3 if i % 5 else None, u) for i, u in enumerate(urls())]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in url_filters.op13_url_filters(spark, str(tmp_path)).collect())
    assert got == Counter((k, *brute_judge(u, url_filters.RULES)) for k, u in rows)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == Counter(con.execute(url_filters._SQL).fetchall())


@pytest.mark.parametrize("broadcast_rules", [0, 1000])
def test_url_rules(spark, broadcast_rules):
    """Many rules: of one host, of one text, empty and null ones, joined with and without a broadcast."""
    rng = random.Random(5)
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choice(["a", "b", "example", "com", "org"]) for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/f", "/fr/", "/en/1", "/de/", "/é"])) for _ in range(60)]
    rules += [("block", "com", "/fr/"), ("allow", "com", "/fr/"), ("allow", "ORG", "/es/"), ("warn", "net", "/")]
    odd = [(None, "org", "/"), ("block", None, "/"), ("block", "", "/"), ("block", "example.net", None)]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls())], "page_id long, url string, rule string, short string").repartition(4)
    got = url_filters.judge_urls(pages, spark.createDataFrame(rules + odd, "verdict string, host string, path string"), "block", carry=("page_id", "rule", "short"), broadcast_rules=broadcast_rules)
    clean = [(v, "".join(c.lower() if "A" <= c <= "Z" else c for c in h), p) for v, h, p in rules] + [("block", "example.net", "")]
    assert sorted(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == sorted(((i, *brute_judge(u, clean, "block")) for i, u in enumerate(urls())), key=lambda x: x[0])
    assert got.filter("rule_carried = 'r' and short = 'h'").count() == len(urls())


def test_url_filters_of_nothing(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), none).collect() == []
    assert tuple(url_filters.judge_urls(spark.createDataFrame([(1, "http://a.org/x?y")], "page_id long, url string"), none).first()) == (1, "a.org", "/x", None, "allow")
