"""The corpus operators against brute force, round trips and odd rows."""

import hashlib
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
# columns beyond those read, with names that operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, node long, score double"
LONG = "Lorem ipsum dolor sit amet. " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "a", "Same Text", "same text", "SAME TEXT", "same text", LONG, LONG.upper(), "é 日本語 <|endoftext|> x", "a  b \n c", "tab\tand\x1cfs"]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, "x", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "same text", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def body(row):
    return row["text"] or ""


def test_token_files_round_trip(odd, empty):
    from tokenizers import Tokenizer

    from millrace.llm.token_file import token_table

    exact = Tokenizer.from_file(BPE)
    got = token_table(odd, BPE, end_id=0).collect()
    source = sorted(odd.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in source]
    start = 0
    want, have = [], []
    for r, s in zip(got, source):
        ids = [*exact.encode(body(s), add_special_tokens=False).ids, 0]
        want.append((s["doc_id"], len(ids), zlib.crc32(array("I", ids).tobytes())))
        have.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
        assert r["start"] == start
        start += r["n_tokens"]
    assert sorted(want, key=repr) == sorted(have, key=repr)
    assert token_table(empty, BPE).collect() == []


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], list(range(1000)), [0] * 700 + [10**6] * 300, [2**33, 2**33 + 1]])
def test_elias_fano_selects(values):
    from millrace.llm.token_file import EliasFano

    ef = EliasFano.build(np.array(values, dtype=np.uint64))
    assert [ef.select(i) for i in range(len(values))] == values


def test_secrets_match_python(spark, empty):
    from millrace.llm.secret_scan import BASE_RULES, find_secrets, trigram_query

    texts = [
        None, "", "password: hunter2", "Password = 'abcdefghijkl'", "token: token: AAAAAAAAAAAA", "secret=secret=abcdefghijkl",
        "AKIA" + "A" * 14, "AKIAAKIA" + "B" * 12, "AKIA" + "A" * 13, "0123456789abcdef", "é" * 5 + " deadbeefdeadbeefdead api_key=ABCDEFGHIJKLMN apikey:short",
        "x " * 20000 + "passwd:" + "z" * 40,
    ]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts + texts[3:4])], "doc_id long, text string, key string")
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ]
    for r in find_secrets(df).collect():
        text = (texts + texts[3:4])[r["doc_id"]] or ""
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(base) for m in p.finditer(text) if len(m.group(g)) >= n)
        joined = ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r["spans"] == joined
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
    # rows without an id, and further kinds: base columns stay as they are
    from millrace.llm.secret_scan import MORE_RULES

    more = [("private", "-----BEGIN RSA PRIVATE KEY-----"), ("github", "github_pat_" + "Z9" * 11), ("slack", "xoxb-0123456789-abc"), ("stripe", "sk_live_" + "Z" * 24), ("google", "AIza" + "Y" * 35)]
    odd = spark.createDataFrame([(None, f"x {t} y") for _, t in more] + [(None, "token: abcdefghijkl")] * 2, "doc_id long, text string")
    found = sorted((r["spans"], r["n_assign"]) for r in find_secrets(odd, rules=(*BASE_RULES, *MORE_RULES)).collect())
    assert found == sorted([(f"{kind}:2:{2 + len(t)}", 0) for kind, t in more] + [("assign:0:19", 1)] * 2)
    assert all(trigram_query(r.pattern) is not None for r in MORE_RULES)
    assert trigram_query(BASE_RULES[2].pattern) is None
    assert trigram_query("ab(cde|f)+g?") is None and trigram_query("ab(cde)+g?") == "cde"
    assert trigram_query("abcd(efg|hij)") == ("and", "abc", "bcd", ("or", "efg", "hij"))
    assert find_secrets(empty).collect() == []


def test_exact_groups(odd, empty, more_partitions):
    from millrace.llm.exact_dedup import drop_exact_copies, exact_groups

    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    source = odd.collect()
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_groups(odd, keep=keep).collect()
        assert len(got) == len(source)
        groups = {}
        for r in source:
            groups.setdefault(hashlib.sha256(fold(r["text"]).encode()).hexdigest(), []).append(r["doc_id"])
        for r in got:
            own = groups[r["text_sha256"]]
            assert r["group_size"] == len(own) and r["keep_id"] == best(i for i in own if i is not None)
        assert sum(r["kept"] for r in got) == len(groups)
    assert drop_exact_copies(odd).count() == len(groups)
    assert drop_exact_copies(odd).columns == odd.columns
    assert exact_groups(empty).collect() == []


def test_groups_over_partition_edges(spark, more_partitions):
    from millrace.llm.exact_dedup import exact_groups

    df = spark.range(400).selectExpr("id as doc_id", "case when id % 4 = 0 then concat('t', id) else 'Copy' end as text")
    got = exact_groups(df).collect()
    copies = [r for r in got if r["group_size"] > 1]
    assert len(copies) == 300 and {r["keep_id"] for r in copies} == {399} and sum(r["kept"] for r in got) == 101


def test_long_common_openings_and_hot_groups(spark, more_partitions):
    from millrace.llm.exact_dedup import drop_exact_copies, exact_groups

    # all texts open alike for 3000 characters; half of the rows are one text, some without any id
    start = "Same opening. " * 215
    rows = [(i, start + (f"{i % 97}" if i % 2 else "Hot")) for i in range(1200)] + [(None, start + "none")] * 300 + [(7, start + "hot")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = {}
    for i, t in rows:
        want.setdefault(t.lower(), []).append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_groups(df, keep=keep).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
        by = {hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode()).hexdigest(): ids for t, ids in want.items()}
        for r in got:
            ids = by[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == best((i for i in ids if i is not None), default=None)
        kept = drop_exact_copies(df, keep=keep).collect()
        assert sorted((r["text"].lower(), r["doc_id"]) for r in kept if r["doc_id"] is not None) == sorted((t, best(i for i in ids)) for t, ids in want.items() if ids[0] is not None)
        assert len(kept) == len(want)


def test_token_counts(odd, empty):
    import sentencepiece

    from millrace.llm.token_counts import count_tokens, split_text

    exact = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted(((r["doc_id"], len(body(r).encode()), len(exact.encode(body(r)))) for r in odd.collect()), key=repr)
    got = count_tokens(odd, PIECE, part_chars=100).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert " ".join(split_text(LONG, 50)) == LONG and len(split_text(LONG, 50)) > 1000
    assert count_tokens(empty, PIECE).collect() == []


def test_url_rules_and_templates(spark):
    from millrace.llm.url_filter import judge_urls

    urls = [
        None, "nohost", "http://A.Example.ORG/en/12?x", "https://example.org/es/1#a", "http://example.org", "http://notexample.org/es/1",
        "http://x.com/de/1", "http://x.com/fr/1", "http://x.net/fr/1", "http://example.org?a://b", "://", "http://x.com/DE/1",
    ]
    # one host: listed rules block its /de/ pages and allow /fr/; /it/ has no label
    many = [f"http://h.com/{p}/{i}" for i in range(60) for p in ("de", "fr", "it")]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls + many)], "page_id long, url string, template string")
    got = {r["page_id"]: r for r in judge_urls(df).collect()}
    assert len(got) == len(urls + many)
    want = [None, None, "example.org/en/1", "example.org/es/", None, "org/", "com/de/", "com/fr/", None, None, None, None]
    assert [got[i]["rule"] for i in range(len(urls))] == want
    assert (got[2]["host"], got[2]["path"]) == ("a.example.org", "/en/12") and (got[0]["host"], got[0]["path"]) == ("", "")
    assert (got[9]["host"], got[9]["path"]) == ("example.org", "") and {r["verdict"] for r in got.values()} == {"allow", "block"}
    trees = {r["path"][:4]: (r["template"], r["verdict"]) for r in got.values() if r["host"] == "h.com"}
    # /de/ and /fr/ are pure, so that there is nothing to tell apart below them
    assert trees == {"/de/": ("/de/**", "block"), "/fr/": ("/fr/**", "allow"), "/it/": ("/it/**", trees["/it/"][1])}
    empty = spark.createDataFrame([], df.schema)
    assert judge_urls(empty).collect() == []


def plain_tree(paths, overall, z=3.0, prior=4.0):
    """Template and purity of each (host, segments) of ``paths``: (allowed, blocked), by recursion."""
    out = {}

    def apart(b1, n1, b2, n2):
        p, q = (b1 + 1) / (n1 + 2), (b2 + 1) / (n2 + 2)
        return abs(p - q) > z * (p * (1 - p) / (n1 + 2) + q * (1 - q) / (n2 + 2)) ** 0.5

    def walk(own, depth, template, above):
        a, b = (sum(v[k] for v in own.values()) for k in (0, 1))
        share = (b + prior * above) / (a + b + prior)
        if not a or not b:
            out.update({key: (template + ("/**" if len(key[1]) > depth else ""), share) for key in own})
            return
        branches = {}
        for key, v in own.items():
            branches.setdefault(key[1][depth] if len(key[1]) > depth else None, {})[key] = v
        ends = branches.pop(None, {})
        a, b = (sum(v[k] for v in ends.values()) for k in (0, 1))
        out.update(dict.fromkeys(ends, (template, (b + prior * share) / (a + b + prior))))
        sums = {name: [sum(v[k] for v in rows.values()) for k in (0, 1)] for name, rows in branches.items()}
        groups, rest = [], [name for name in sums if not sum(sums[name])]
        for pair in sorted({tuple(v) for v in sums.values() if sum(v)}, key=lambda v: (-sum(v), -v[1])):
            # branches with equal counts are judged together
            n, blocked, same = sum(pair), pair[1], [name for name in sums if tuple(sums[name]) == pair]
            near = min(groups, key=lambda g: abs(g["b"] / g["n"] - blocked / n), default=None)
            if near is None or apart(blocked, n, near["b"], near["n"]):
                near = {"names": [], "b": 0, "n": 0}
                groups.append(near)
            near["names"] += same
            near["b"] += blocked * len(same)
            near["n"] += n * len(same)
        if rest and len(groups) == 1:
            groups[0]["names"] += rest
        elif rest:
            groups.append({"names": rest})
        for g in groups:
            names = sorted(g["names"])
            step = "|".join(names[:3]) + (f"|+{len(names) - 3}" if len(names) > 3 else "")
            walk({k: v for name in names for k, v in branches[name].items()}, depth + 1, f"{template}/{step if len(names) == 1 else f'({step})'}", share)

    for host in {h for h, _ in paths}:
        walk({k: v for k, v in paths.items() if k[0] == host}, 0, "", overall)
    return out


def test_url_trees_match_a_plain_tree(spark):
    from millrace.llm.url_filter import path_templates

    random = np.random.default_rng(6)
    paths = {}
    for h in range(12):
        for _ in range(150):
            segments = tuple(random.choice(list("abcdefgh"), random.integers(0, 5)))
            rate = 0.9 if "a" in segments[1:2] or (h % 3 == 0 and "b" in segments[2:]) else 0.1
            n = int(random.integers(0, 25)) * int(random.random() < 0.7)
            blocked = int(random.binomial(n, rate)) if h else 0
            paths[f"h{h}", segments] = (n - blocked, blocked)
    df = spark.createDataFrame([(h, list(p), a, b) for (h, p), (a, b) in paths.items()], "host string, segments array<string>, allowed long, blocked long")
    want = plain_tree(paths, 0.3)
    got = {(r["host"], tuple(r["segments"])): (r["template"], r["purity"]) for r in path_templates(df, 0.3, 3.0, 4.0).collect()}
    assert set(got) == set(want)
    for key, (template, share) in want.items():
        assert got[key] == (template, pytest.approx(share))
    assert len({t for t, _ in want.values()}) > 40


def test_url_branches_alike_are_merged(spark):
    from millrace.llm.url_filter import UrlRule, judge_urls, merge_branches

    assert merge_branches([(6, 54, 2), (60, 0, 2), (0, 0, 5), (0, 1, 3)], 3.0) == {(6, 54): 0, (60, 0): 1, (0, 1): 0, (0, 0): -1}
    # twelve segments deep, and only the last tells; the list says which is which
    deep = "/".join("abcdefghijk")
    rules = (UrlRule("allow", "org", f"/{deep}/good/1"), UrlRule("block", "org", f"/{deep}/bad/1"))
    urls = [f"http://x.org/{deep}/{kind}/{i}" for kind in ("good", "bad") for i in range(100)]
    rows = [(i, u, "x") for i, u in enumerate([*urls, urls[0], "http://y.org/" + "a" * 50_000, None])]
    df = spark.createDataFrame([*rows, (None, urls[150], "y")], "page_id long, url string, host string")
    got = judge_urls(df, rules=rules).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["host"] and len(r["path"]) < 1000:
            assert r["verdict"] == ("allow" if "/good/" in r["path"] else "block"), r
    assert {r["template"] for r in got if "/good/" in r["path"]} == {f"/{deep}/good/**"}


def test_network_gradients_agree_with_differences():
    from millrace.llm.language import ByteGru, encode_passages

    model = ByteGru(["a", "b", "c"], hidden=3)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    codes, mask = encode_passages([b"abc", b"de", b"abcdef"])
    labels = np.array([0, 1, 2])
    _, grads = model.loss_and_gradients(codes, mask.astype(float), labels)
    random = np.random.default_rng(1)
    for name, value in model.weights.items():
        for _ in range(4):
            at = tuple(random.integers(0, n) for n in value.shape) if not name.endswith("_in") else (int(random.choice([97, 100])), int(random.integers(0, 9)))
            value[at] += 1e-5
            up, _ = model.loss_and_gradients(codes, mask.astype(float), labels)
            value[at] -= 2e-5
            down, _ = model.loss_and_gradients(codes, mask.astype(float), labels)
            value[at] += 1e-5
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_language_of_held_out_documents(spark, odd, empty):
    from millrace.llm.language import identify, keep_identified

    words = {"xx": ["kato", "mika", "toka", "kimo"], "yy": ["zurg", "grub", "burz", "zugr"]}
    rows = [(i, " ".join(words[lang][(i + k) % 4] for k in range(12)), lang) for i in range(200) for lang in ("xx" if i % 2 else "yy",)]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34!", "xx"), (902, "kato mika", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(df, epochs=2).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "xx"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert keep_identified(df, epochs=2).count() == len(rows) + 1
    assert identify(odd, epochs=1).count() == odd.count()
    assert identify(empty).collect() == []


def test_reader_matches_the_whole_text():
    from millrace.llm.language import ByteGru, Reader, encode_passages

    model = ByteGru(["a", "b", "c"], hidden=5, others=1)
    texts = ["", "x", "one two", "eight by", "日本語" * 9, "long text " * 13, "é"]
    for core, together in ((7, 3), (256, 1024)):
        found = Reader(model, core, context=500, together=together).texts(texts)
        assert not found[0].any()
        for text, own in zip(texts[1:], found[1:]):
            whole = np.exp(model.log_probabilities(*encode_passages([text.encode()])))[:, 0]
            assert own == pytest.approx(whole.mean(axis=0)[:3], abs=1e-5)


def test_language_needs_context(spark):
    from millrace.llm.language import identify

    # both languages have the same words: only their order tells
    orders = {"xx": "kato kato mika mika", "yy": "kato mika kato mika"}
    rows = [(i, " ".join([orders["xx" if i % 2 else "yy"]] * (3 + i % 5)), "xx" if i % 2 else "yy") for i in range(400)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=64, epochs=40).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean([r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "yy") for r in held]) > 0.95


def test_language_learns_from_rows_of_one_id(spark):
    from millrace.llm.language import identify

    for own in (8, 3):
        df = spark.range(9000).selectExpr(f"{own} as doc_id", "case when id % 2 = 0 then 'kato mika' else 'zurg grub' end as text", "case when id % 2 = 0 then 'xx' else 'yy' end as lang")
        got = identify(df, per_language=50).groupBy("lang_pred", "held_out").count().collect()
        assert sorted(map(tuple, got)) == [("xx", False, 4500), ("yy", False, 4500)]


def test_rejected_documents(spark):
    from millrace.llm.language import keep_identified

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    random = np.random.default_rng(4)
    letters = ["".join(map(chr, np.where(random.random(300) < 0.15, 32, first + random.integers(0, 26, 300)))) for first in (0x61, 0x430, 0x3B1)]
    strange = [(10**6 + i, t, None, None, None) for i, t in enumerate([*letters, "这是一个没有空格的句子" * 9, None, "", "123 !?"])]
    kept = keep_identified(docs.unionByName(spark.createDataFrame(strange, docs.schema)))
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not [i for i in ids if i >= 10**6] and len(ids & clean) >= 0.998 * len(clean)
    # nothing to learn from: nothing is rejected
    unlabelled = docs.limit(20).withColumn("lang", docs["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")
    assert keep_identified(unlabelled).count() == 20


def test_neighbours_recall(spark):
    from millrace.llm.neighbours import nearest

    random = np.random.default_rng(5)
    points = random.normal(size=(1200, 8)) * random.uniform(0.5, 2, (1200, 1))
    points[100:160] = points[100]  # equal vectors
    rows = [(i, p.tolist(), 1.0) for i, p in enumerate(points)]
    rows += [(2000, None, 0.0), (2020, [0.0] * 8, 0.0), (2040, [float("nan")] * 8, 0.0), (2060, [None] * 8, 0.0), (None, [1.0] * 8, 0.0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = {}
    for r in nearest(df, shard_rows=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1200, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        exact = points @ points[q]
        exact[q] = -np.inf
        best = np.lexsort((np.arange(1200), -exact))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(exact[v]) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9
    assert nearest(spark.createDataFrame([], df.schema)).collect() == []


def test_neighbours_of_odd_rows(spark):
    from millrace.llm.neighbours import nearest

    random = np.random.default_rng(11)
    # small whole numbers, so that scores tie
    rows = [(i, random.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    rows += [(20, [9.0, 0.0, 0.0, 0.0]), (20, [0.0, 9.0, 0.0, 0.0]), (40, rows[40][1]), (300, [1.0, 2.0]), (301, [2.0]), (302, [0.0, 0.0]), (303, None)]
    usable = [(i, v) for i, v in rows if v is not None and any(v)]
    full = [(i, np.array([*v, *[0.0] * (4 - len(v))])) for i, v in usable]
    want = {}
    for q, v in full:
        if q % 20 == 0:
            found = [(-float(v @ w), i) for i, w in full]
            found.remove((-float(v @ v), q))
            want[q, tuple(v)] = [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:20])]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = {}
        for r in nearest(df, shard_rows=60, block_rows=3).collect():
            got.setdefault((r["query_id"], r["query_copy"]), []).append((r["rank"], r["vec_id"], r["score"]))
        # a query for each different vector of an id
        assert sorted((q, sorted(own)) for (q, _), own in got.items()) == sorted((q, own) for (q, _), own in want.items())


@pytest.mark.parametrize("group", [50, 500, 5000])
def test_neighbours_in_groups(group):
    from millrace.llm.neighbours import Graph

    random = np.random.default_rng(8)
    centres = random.normal(size=(10_000 // group, 64))
    points = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), group, axis=0) + random.normal(size=(10_000, 64)) * 0.03
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    found, _ = Graph.build(points).search(points[::25], 20, 128)
    exact = np.argsort(-(points[::25] @ points.T), axis=1)[:, :20]
    hits = [len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), exact.tolist())]
    assert np.mean(hits) >= 0.99 and min(hits) >= 0.5


def test_darts_estimate_weighted_similarity():
    from millrace.llm.darts import mix, signatures

    names = mix(np.arange(1, 301, dtype=np.uint64))
    a, b = np.ones(300), np.concatenate([np.ones(150), np.full(150, 3.0)])
    weights = np.concatenate([a, b])
    owners = np.repeat([0, 1], 300)
    sig = signatures(np.concatenate([names, names]), weights, owners, 3, 1024)
    similarity = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(similarity, abs=0.06)
    assert not sig[2].any()


def test_near_classes_match_brute_force(spark, odd, empty):
    from millrace.llm.near_dedup import drop_near_copies, near_classes

    random = np.random.default_rng(2)
    docs = {}
    for g in range(30):
        base = [f"w{x}" for x in random.integers(0, 400, 120)]
        for k in range(random.integers(1, 12)):
            own = list(base)
            for at in random.integers(0, 120, random.integers(0, 6)):
                own[at] = f"v{random.integers(0, 10**6)}"
            docs[len(docs)] = " ".join(own)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in docs:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for block in (256, 8):  # 8: families of several blocks
        got = {r["doc_id"]: r["class_id"] for r in near_classes(df, block=block).collect()}
        assert got == {i: root(i) for i in docs}
    assert drop_near_copies(df).count() == len({root(i) for i in docs})
    rows = near_classes(odd).collect()
    assert len(rows) == odd.count() and all((r["class_id"] is None) == (r["doc_id"] is None) for r in rows)
    assert near_classes(empty).collect() == []


def test_near_classes_weigh_repeated_shingles(spark):
    from collections import Counter

    from millrace.llm.near_dedup import near_classes

    random = np.random.default_rng(7)
    docs = {}
    for _ in range(12):
        lines = [" ".join(f"w{x}" for x in random.integers(0, 300, 8)) for _ in range(12)]
        for _ in range(8):
            times = random.integers(1, 4, 12) if random.random() < 0.3 else np.ones(12, int)
            if random.random() < 0.5:
                times[random.integers(0, 12)] = random.choice([1, 2, 30])
            docs[len(docs)] = " ".join(line for line, n in zip(lines, times) for _ in range(n))
    docs |= {len(docs) + i: " ".join(["same"] * n) for i, n in enumerate((3, 400, 399, 330, 300))}
    bags = {i: Counter(tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in docs:
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_classes(df).collect()}
    assert got == {i: root(i) for i in docs} and 10 < len(set(got.values())) < len(docs) - 20


def test_near_classes_join_all_texts_of_an_id(spark):
    from millrace.llm.near_dedup import drop_near_copies, near_classes

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    texts = [(0, a), (0, b), (0, None), (1, a + " z"), (2, b + " z"), (3, b), (4, c + " z"), (5, c), (5, ""), (6, None), (6, ""), (9, c), (9, a), (None, a)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_classes(df).collect()), key=repr)
    # ids 0 and 9 have several texts: their classes are one
    want = [(i, None if i is None else 6 if i == 6 else 0, 1 if i is None else 2 if i == 6 else 11) for i, _ in texts]
    assert got == sorted(want, key=repr)
    assert sorted((r["doc_id"] for r in drop_near_copies(df).collect()), key=repr) == [0, 0, 0, 6, 6, None]


def test_packing_covers_every_id_once(odd, empty):
    from tokenizers import Tokenizer

    from millrace.llm.packing import best_fit_decreasing, pack

    exact = Tokenizer.from_file(BPE)
    want = sorted(len(exact.encode(body(r), add_special_tokens=False).ids) + 1 for r in odd.collect())
    got = pack(odd, BPE, size=64, pool_ids=500).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r["length"] for r in got) == sum(want)
    assert pack(empty, BPE).collect() == []
    place, used = best_fit_decreasing([6, 5, 4, 3, 2], 10)
    assert used == [10, 10] and place == [0, 1, 0, 1, 1]


def test_pieces_match_the_library(spark):
    from tokenizers import Tokenizer

    from millrace.llm.packing import best_fit_decreasing, pack

    exact = Tokenizer.from_file(BPE)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {i: [*exact.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, windows = {}, {}
    for r in pack(docs, BPE, size=256).collect():
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(array("I", part).tobytes()) and len(part) == r["length"] and r["doc_tokens"] == len(own)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [start for start, _ in sorted(own)] == ends[:-1] and ends[-1] == len(ids[i])
    padding = 0
    for own in windows.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 256
        padding += 256 - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    assert padding < 0.01 * sum(map(len, ids.values()))

    # best fit against a plain search for the tightest open window
    random = np.random.default_rng(3)
    for _ in range(20):
        lengths = random.integers(1, 100, random.integers(1, 200)).tolist()
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [room for room in rooms if room >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 100) - n)
        place, used = best_fit_decreasing(lengths, 100)
        assert sorted(100 - u for u in used) == sorted(rooms)
        assert used == [sum(n for n, w in zip(lengths, place) if w == k) for k in range(len(used))]


def test_mix_meets_its_targets(spark, odd, empty):
    from millrace.llm.mixing import mix, mixed_documents

    rows = [(i, " ".join(["w"] * (i % 37)), None if i % 11 == 0 else f"s{i % 5}" if i % 2 else "big") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == r["doc_id"] % 37
    order = sorted((s for s in by if s is not None)) + [None]
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(1.5 * total)
    free = {}
    for k, s in enumerate(order):
        own = by[s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=1)
        assert own[0]["target"] <= 2 * own[0]["source_size"]
        if own[0]["target"] < 2 * own[0]["source_size"]:
            free[s] = own[0]["target"] / (3, 1, 2)[k % 3]
    assert max(free.values(), default=1) == pytest.approx(min(free.values(), default=1))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df.repartition(7)).collect()), key=repr)
    taken = mixed_documents(df)
    assert taken.columns == df.columns
    words = {}
    for r in taken.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
        assert r["text"] in (" ".join(["w"] * (r["doc_id"] % 37)),)  # whole, never a prefix
    assert all(abs(words[s] - own[0]["target"]) <= 18 for s, own in by.items())
    assert mix(odd).count() == odd.count() and mix(empty).collect() == [] and mixed_documents(empty).collect() == []


def test_mix_of_rows_without_ids(spark, more_partitions):
    from millrace.llm.mixing import mix, mixed_documents

    # different texts without an id are ordered by text; rows that repeat id and text share what is left
    rows = [(None, f"w{i} " * (1 + i % 9), "a") for i in range(300)] + [(5, "one two three four", "b")] * 400 + [(6, "x y", "c")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=len(own) if source != "a" else 1)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(df.repartition(5)).collect()), key=repr)
    words = {}
    for r in mixed_documents(df).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    targets = {r["source"]: r["target"] for r in got}
    assert all(words[s] == pytest.approx(t, rel=0.1, abs=9) for s, t in targets.items())


CLASH = "c0 c1 body tie part hot node rank size cut copies rest chance turn place lang_pred score __gone __id __sha __size class_id source_key".split()


def test_pipeline_stages_on_odd_tables(spark, odd, empty):
    import corpus_pipeline

    own = ["doc_id", "text", "lang", "source", "n_chars"]
    wide = odd.select(*own, *[(odd["doc_id"] + i).alias(c) for i, c in enumerate(CLASH)])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, wide, "")
        assert got.columns == wide.columns, name
        for r in got.collect():
            assert r["doc_id"] is None or r["score"] == r["doc_id"] + CLASH.index("score"), name
        assert stage(spark, wide.limit(0), "").collect() == [], name
        assert stage(spark, empty.select(*own), "").columns == own
    assert corpus_pipeline.STAGES[4][1](spark, wide, "").count() >= wide.count()
    kept = corpus_pipeline.exact_dedup(spark, wide, "").collect()
    assert len(kept) == len({"".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "") for r in wide.collect()})


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    random = np.random.default_rng(9)
    rows = [tuple(r) for r in docs.collect()]
    noise = [(5000 + i, "".join(map(chr, np.where(random.random(400) < 0.15, 32, 0x430 + random.integers(0, 26, 400)))), None, "src0", 400) for i in range(3)]
    long = [r for r in rows if r[1] and len(r[1].split()) > 80]
    copies = [(6000 + i, r[1].upper(), *r[2:]) for i, r in enumerate(long[:5])] + [(7000 + i, r[1] + " zz", *r[2:]) for i, r in enumerate(long[5:12])]
    spark.createDataFrame([*rows, *noise, *copies], docs.schema).write.parquet(str(tmp_path / "documents.parquet"))

    def fold(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    # language: only the noise goes; exact: the largest id of each text stays
    texts = {}
    for r in sorted([*rows, *copies], key=lambda r: r[0]):
        texts[fold(r[1])] = r
    left = {r[0]: r for r in texts.values()}
    # near: the least id of each class of linked shingle bags
    from collections import Counter

    bags = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := (r[1] or "").lower().split()) else Counter() for i, r in left.items()}
    root = {i: i for i in left}
    for _ in range(3):
        for i in left:
            for j in left:
                if i < j and bags[i] and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                    root[i] = root[j] = min(root[i], root[j])
    left = {i: r for i, r in left.items() if root[i] == i}
    # mixing: the level by bisection, then a walk along the ranks
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in left.items()}
    sources = sorted({r[3] for r in left.values()}, key=lambda s: (s is None, s))
    total = {s: sum(sizes[i] for i, r in left.items() if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], weight[s] * level) for s in sources) < 1.5 * sum(total.values()) else (low, level)
    times = {}
    for s in sources:
        target = min(2 * total[s], weight[s] * low)
        whole = int((target + 1e-6) // total[s])
        missing = round(target - whole * total[s])
        own = sorted((hashlib.md5(f"mix-1|{i}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest(), i) for i, r in left.items() if r[3] == s)
        for _, i in own:
            times[i] = (whole + (missing >= sizes[i] / 2 and missing > 0)) * bool(sizes[i])
            missing -= sizes[i]
    exact = Tokenizer.from_file(BPE)
    want = {i: n * (len(exact.encode(left[i][1], add_special_tokens=False).ids) + 1) for i, n in times.items() if n}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and len(want) > 100


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, "/root/testdata/sf0.001")
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = spark.createDataFrame(after.collect(), T.StructType(docs.schema.fields))


def test_memo_of_pieces_is_bounded():
    from millrace.llm.bpe import PieceEncoder

    coder = PieceEncoder(BPE, 1000)
    few, long = [f"abc{i}x" for i in range(100)], ["y" * 6000 + chr(97 + i) for i in range(20)]
    for texts in (few, [" ".join(f"w{i:05d}q" for i in range(5000))], few, long, few):
        assert [x.tolist() for x in coder.encode_many(texts)] == [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(coder.known) <= 1000 and sum(map(len, coder.known)) <= 64_000
    assert coder.known


def test_least_score_reads_every_held_out_document(spark, monkeypatch):
    from millrace.functions import quantiles
    from millrace.llm import language

    # 1200 held-out documents, of which those of the highest ranks are like no language
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 4 == 2][:1200]
    held.sort(key=lambda i: hashlib.md5(f"language|{i}".encode()).hexdigest())
    words = {"xx": "kato mika toka kimo ", "yy": "zurg grub burz zugr "}
    odd = held[-60:]
    rows = [(i, (words["xx" if i % 2 else "yy"] if i not in odd else "δέ ") * 9, "xx" if i % 2 else "yy") for i in held]
    df = spark.createDataFrame([*rows, (held[0], "12 34!", "xx"), (held[0], None, "xx"), (held[0], "δ", None), (None, "δ", "xx")], "doc_id long, text string, lang string")
    model = language.ByteGru(["xx", "yy"], hidden=4, others=1)
    model.weights["out_bias"][2] = 2
    scores = language.Reader(model).texts([t for _, t, _ in rows]).max(axis=1)
    want = min(0.5, 0.5 * np.quantile(scores, 0.01))
    assert language.least_score(df, model) == pytest.approx(want, rel=1e-5)
    # the same from scores in a distributed order
    monkeypatch.setattr(language, "quantiles", lambda df, columns, shares, in_memory: quantiles.quantiles(df, columns, shares, 0))
    assert language.least_score(df, model) == pytest.approx(want, rel=1e-5)
    assert language.least_score(df.where("lang is null"), model) == 0


def test_reader_needs_bounded_memory():
    import tracemalloc

    from millrace.llm.language import ByteGru, Reader

    reader, flat = Reader(ByteGru(["a", "b"], others=1)), np.full(1 << 19, 97, np.uint8)
    tracemalloc.start()
    reader.documents(flat, np.array([0, len(flat)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45e6


def test_components_of_few_edges_write_nothing(spark, monkeypatch):
    from millrace.llm import components as module

    random = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in random.integers(-300, 300, (330, 2))]
    edges = spark.createDataFrame([*pairs, pairs[0], pairs[0][::-1]], "u long, v long")
    parent = {}
    for a, b in pairs:
        while parent.setdefault(a, a) != a:
            a = parent[a]
        while parent.setdefault(b, b) != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(x):
        return x if parent[x] == x else root(parent[x])

    expected = sorted((x, root(x)) for pair in pairs if pair[0] != pair[1] for x in set(pair))
    written = []
    monkeypatch.setattr(module, "settle", lambda df, label, real=module.settle: written.append(label) or real(df, label))
    assert sorted(map(tuple, module.components(edges).collect())) == sorted(set(expected)) and not written
    assert sorted(map(tuple, module.components(edges, on_driver=100).collect())) == sorted(set(expected)) and written
    assert module.components(edges.where("u = v")).collect() == []


def test_labelled_sample_starts_no_workers_of_its_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.llm.language import labelled_sample

    rows = spark.createDataFrame([(i, f"some text {i}", "ab"[i % 2]) for i in range(20)], "doc_id long, text string, lang string").localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("rows from a list go through Python workers"))
    found = labelled_sample(rows, "doc_id", "text", "lang", F.lit(True), 3, 2, 128)
    assert [name for name, _ in found] == ["a"] * 3 + ["b"] * 3


def test_workers_give_memory_back():
    import multiprocessing
    from pathlib import Path

    import pyarrow as pa

    from millrace.llm.common import tidy

    def held():
        return int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def run(batches):
        kept = [[bytes(600 + i % 50) for i in range(100_000)] for _ in batches]
        yield held()
        del kept

    def body(pipe):
        before = held()
        used, *_ = [*tidy(run)(iter([pa.record_batch({"x": [1]})]))]
        pipe.send((before, used, held()))

    ours, theirs = multiprocessing.Pipe()
    task = multiprocessing.get_context("fork").Process(target=body, args=(theirs,))
    task.start()
    before, used, after = ours.recv()
    task.join()
    assert used - before > 50 and after - before < 0.3 * (used - before)


def test_new_pieces_go_to_the_library_in_groups():
    from millrace.llm.bpe import PieceEncoder

    coder = PieceEncoder(BPE)
    merges, strings = coder.merges, []

    class Counted:
        def encode_batch_fast(self, batch, **options):
            strings.extend(x for text in batch for x in text)
            return merges.encode_batch_fast(batch, **options)

    coder.merges = Counted()
    words = [f"{a}{b}{c}" for a in ("str", "qu", "Él", "x'", "7") for b in "aeiouyäß" for c in ("nt", "ÿþ", "12", "..", "\n\n", "'ll", "w" * 400)]
    texts = [" ".join(words), "\n".join(words), "", "  \t\r\n ", "a\0b\1c", "ÿ", " ", "<|endoftext|>x", "мир 世界", *words]
    want = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in coder.encode_many(texts)] == want
    # two strings a piece before
    assert 200 < len(coder.known) and len(strings) <= len(coder.known) / 32 + 1


@pytest.mark.parametrize("options", [{}, {"ignore_merges": True}, {"merged": True}])
def test_models_made_here_match_the_library(tmp_path, options):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from millrace.llm.bpe import _UNUSED, PieceEncoder, _byte_letters

    letters, options = _byte_letters(), dict(options)
    merges = [("a", "b"), ("ab", "c"), ("b", "c"), ("Ġ", "a")]
    if options.pop("merged", False):
        merges += [("a", letters[b]) for b in _UNUSED] + [("c", letters[b]) for b in _UNUSED]
    vocab = {x: i for i, x in enumerate(dict.fromkeys([*letters, *map("".join, merges), "cab"]))}
    made = Tokenizer(models.BPE(vocab, merges, **options))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    made.save(path := str(tmp_path / "made.json"))
    coder = PieceEncoder(path)
    assert coder.cuts and (coder.mark is not None) == (options == {} and len(merges) == 4)
    texts = ["abc cab bc", "cab\nab  a", "", "äb abcÿ cabcab", "世 abc"]
    assert [x.tolist() for x in coder.encode_many(texts)] == [x.ids for x in made.encode_batch(texts, add_special_tokens=False)]


def test_memo_of_pieces_after_a_failure():
    from millrace.llm.bpe import PieceEncoder

    coder = PieceEncoder(BPE)
    want = coder.tokenizer.encode("some words", add_special_tokens=False).ids
    coder.merges, merges = None, coder.merges
    with pytest.raises(AttributeError):
        coder.encode_many(["some words"])
    coder.merges = merges
    assert coder.encode_many(["some words"])[0].tolist() == want
