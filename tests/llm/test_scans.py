"""Scans, mixing, sharding, token files and the pipeline against plain implementations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import license_scan, mixing, queries, secrets_scan, sharding, token_files, toxicity
from tessera.llm.common import materialize, trimmed


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    order = sorted(want.columns)
    key = lambda df: df[order].sort_values(order).reset_index(drop=True)
    assert sorted(got.columns) == order
    import pandas as pd

    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False)


def plain_targets(rows):
    """Words and target of each source of (size, source)."""
    sizes = Counter()
    for n, s in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets, left, rest = {}, 1.5 * sum(sizes.values()), set(order)
    while rest:
        level = left / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
        rest -= over
    return sizes, targets | {s: level * weight[s] for s in rest}


def test_mixing_meets_targets(tricky_docs, tricky):
    got = mixing.mix(tricky_docs).collect()
    assert len(got) == len(tricky)
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in tricky)
    sizes, targets = plain_targets([(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for _, t, s in tricky])
    order = list(targets)
    want = Counter((sizes[s], round(targets[s], 3)) for _, _, s in tricky)
    assert Counter((r.source_size, round(r.target, 3)) for r in got) == want
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], r.size)
    for (size, target), n in taken.items():
        if len([s for s in order if sizes[s] == size]) == 1:
            assert n <= target + 1e-6 and target - n <= largest[size, target]


def plain_mix(rows, targets, seed="mix"):
    """Takes of a greedy walk by Pareto rank: doc_id -> copies, and the inclusion probabilities of the extra copy."""
    out, odds = {}, {}
    for source, target in targets.items():
        mine = [(i, n, max(1, int(n**0.5))) for i, n, s in rows if s == source]
        total = sum(n for _, n, _ in mine)
        whole = int(target // total)
        left = target - whole * total
        sure = set()
        while True:  # the largest are certain until the rest's probabilities are below one
            rest = [m for m in mine if m[0] not in sure]
            c = (left - sum(n for i, n, _ in mine if i in sure)) / max(1, sum(n * w for _, n, w in rest))
            top = max((w for _, _, w in rest), default=0)
            if c * top <= 1:
                break
            sure |= {i for i, _, w in rest if w == top}
        pi = {i: 1.0 if i in sure else c * w for i, _, w in mine}
        odds |= pi
        room = left - sum(n for i, n, _ in mine if i in sure)
        u = {i: (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i, _, _ in mine}
        for i, n, _ in sorted(mine, key=lambda r: (r[0] not in sure, u[r[0]] / (1 - u[r[0]]) * (1 - pi[r[0]]) / max(pi[r[0]], 1e-300), r[0])):
            fits = i in sure or (n <= room and left > 0)
            room -= n * (fits and i not in sure)
            out[i] = whole + fits
    return out, odds


@pytest.mark.parametrize("fold", [0, mixing.FOLD])
def test_mixing_fills_past_a_long_boundary_document(spark, monkeypatch, fold):
    monkeypatch.setattr(mixing, "FOLD", fold)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 2, 5, 40, 300, 9000 if i % 40 == 0 else 7]), "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in rows], "doc_id bigint, text string, source string").repartition(4)
    got = mixing.mix(docs).collect()
    source = {i: s for i, _, s in rows}
    targets = {source[r.doc_id]: r.target for r in got}
    assert {r.doc_id: r.copies for r in got} == plain_mix(rows, targets)[0]
    for s, target in targets.items():
        mine = [r for r in got if source[r.doc_id] == s]
        least = min(r.copies for r in mine)
        assert 0 <= target - sum(r.taken for r in mine) + 1e-6 < 1 + min(r.size for r in mine if r.copies == least)


def test_mixing_reruns_agree_and_rows_follow(spark, tricky_docs, empty_docs):
    a, b = ({(r.doc_id, r.size): r.taken for r in mixing.mix(d).collect()} for d in (tricky_docs, tricky_docs.repartition(3)))
    assert a == b
    rows = mixing.mix_rows(tricky_docs)
    assert rows.columns == tricky_docs.columns
    n = Counter(r.doc_id for r in rows.select("doc_id").collect())
    for (i, size), taken in a.items():
        if i is not None and i != 11 and size:
            assert n[i] == taken // size
    assert mixing.mix(empty_docs).collect() == [] and mixing.mix_rows(empty_docs).collect() == []


def test_pareto_sampling_follows_odds(spark):
    """Over seeds, the share of takes is the fractional rate, and a document's takes its own inclusion probability."""
    docs = spark.range(400).selectExpr("id as doc_id", "'w w w w w w w w w w' as text", "if(id % 4 = 0, 'a', 'b') as source")
    taken = Counter()
    for seed in range(3):
        for r in mixing.mix(docs, weights=(1,), share=0.5, seed=str(seed)).collect():
            taken[r.source_size] += r.taken
    assert taken == {1000: 3000, 3000: 3 * 1000}
    sizes = {i: (4, 16, 64, 256)[i % 4] for i in range(1200)}
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "a") for i, n in sizes.items()], "doc_id bigint, text string, source string")
    _, odds = plain_mix([(i, n, "a") for i, n in sizes.items()], {"a": 0.3 * sum(sizes.values())})
    share = Counter()
    for seed in range(3):
        got = mixing.mix(docs, share=0.3, seed=f"s{seed}").collect()
        assert {r.doc_id: r.copies for r in got} == plain_mix([(i, n, "a") for i, n in sizes.items()], {"a": 0.3 * sum(sizes.values())}, f"s{seed}")[0]
        share.update(Counter(sizes[r.doc_id] for r in got for _ in range(r.copies)))
    for n in (4, 16, 64, 256):
        assert share[n] / 900 == pytest.approx(odds[(4, 16, 64, 256).index(n)], abs=0.06)
    assert odds[3] > 1.9 * odds[2] > 3.5 * odds[1]


LICENSE_TEXTS = [
    "CC BY-SA 4.0 and cc-by and All Rights Reserved. All rights, reserved",
    "under the GNU General Public License; general public licenses are not",
    "intro " * 30 + license_scan.TEMPLATES["mit"].upper().replace(" ", ", ") + " outro" * 20,
    " ".join(license_scan.TEMPLATES["isc"].split()[:22]),
    "all rights reserved all rights reserved",
    "cc",
    "ccby cc by",
]


def plain_license(text):
    w = [x.decode() for x in license_scan.license_words(text)]
    base = sorted((i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    labels = {label for _, label in base}
    for label, t in license_scan.TEMPLATES.items():
        v = t.split()
        need, width = -(-8 * len(set(v)) // 10), -(-5 * len(v) // 4)
        if any(len(set(w[max(0, e - width) : e]) & set(v)) >= need for e in range(1, len(w) + 1)):
            labels.add(label)
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_license_scan(spark, tricky_docs, empty_docs, tricky, documents):
    rng = random.Random(2)
    texts = [*LICENSE_TEXTS]
    for label in license_scan.TEMPLATES:  # templates with words dropped, in noise
        v = license_scan.TEMPLATES[label].split()
        texts += [" ".join(["noise"] * 9 + [x for x in v if rng.random() > p] + ["noise"] * 9) for p in (0.05, 0.15, 0.3)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in documents[:150]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for r in license_scan.license_scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == plain_license(dict(rows)[r.doc_id]), dict(rows)[r.doc_id][:200]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    got = license_scan.license_scan(tricky_docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, plain_license(t)[0]) if t is None or len(t) < 300_000 else (i, 60_000) for i, t, _ in tricky)
    assert license_scan.license_scan(empty_docs).collect() == []


def test_license_blocks_of_several_notices(spark):
    """All notices of one licence in a text, apart, in a row and damaged; as many as disjoint windows allow."""
    rng = random.Random(7)
    texts, least = [], []
    for t in license_scan.TEMPLATES.values():
        for n, gap, p in ((3, 40, 0), (2, 0, 0), (4, 5, 0.1), (1, 9, 0)):
            parts = [" ".join(w for w in t.split() if rng.random() >= p) + " noise" * gap for _ in range(n)]
            texts.append("start " + " ".join(parts))
            least.append(n if not p else 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    templates = {t.label: t for t in license_scan.ordered(license_scan.TEMPLATES, {})}
    for r in license_scan.license_scan(docs).collect():
        words = license_scan.license_words(texts[r.doc_id])
        by = defaultdict(list)
        for b in r.blocks:
            by[b.label].append(b)
        assert len(by[list(templates)[r.doc_id // 4]]) >= least[r.doc_id]
        for label, t in templates.items():
            most = [0]  # disjoint windows that end at or before each word
            for e in range(1, len(words) + 1):
                starts = [s for s in range(max(0, e - t.width), e) if len(set(words[s:e]) & set(t.tokens)) >= t.needed]
                most.append(max([most[e - 1], *(most[s] + 1 for s in starts[-1:])]))
            got = by[label]
            assert len(got) == most[-1]
            assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))
            for b in got:
                held = len(set(words[b.start : b.end]) & set(t.tokens))
                assert held >= t.needed and b.end - b.start <= t.width and b.score == held / len(t.tokens)


def plain_secrets(text):
    out = []
    for kind, pattern, flags, group, least in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
        ("hex", r"[0-9a-f]+", 0, 0, 24),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


def test_secret_scan(spark, tricky_docs, empty_docs, documents):
    rng = random.Random(4)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [
        "password: hunter22 Passwd='short' API_KEY = \"abc.def=12\" token:::x secret=abcde",
        f"AKIA{key(16, letters[:26])} AKIA{key(15, letters[:26])} xAKIAAKIA{key(30, letters[:26])}",
        f"😀 {key(24, '0123456789abcdef')} {key(23, '0123456789abcdef')} {key(64, '0123456789abcdef')}",
        f"a random {key(40, letters)} and words thatarejustverylongwordsinprose",
        "https://example.org/some/long/path/that/is/no/secret/at/all/index",
        "toKen: abcdefg ſecret: abcdefgh api_Key=abcdefg",
    ]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in documents[:300]] + [(9999, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for r in secrets_scan.secret_scan(docs).collect():
        want = plain_secrets(dict(rows)[r.doc_id] or "")
        n = Counter(x[2] for x in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
        if r.doc_id == 3:
            assert r.spans == f"random:{9}:{49}"
        if r.doc_id == 4:
            assert r.spans == ""
    assert secrets_scan.secret_scan(tricky_docs).count() == 300 - 6 and secrets_scan.secret_scan(empty_docs).collect() == []


def test_randomness_battery():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(500)]
    assert sum(secrets_scan.token_p(k) < 1e-4 for k in keys) >= 490
    # each of the three tests alone turns evidence against words down
    for token in ("ab" * 20, "abcdefghijklmnopqrstuvwxyz0123456789", "Q7" * 20, "0" * 30):
        assert secrets_scan.token_p(token) > 0.05
    for key in keys[:50]:
        (even, p1), (_, p2), (_, p3) = secrets_scan.battery(key)
        assert even > 0 and 0 <= min(p1, p2, p3) <= max(p1, p2, p3) <= 1
        assert secrets_scan.token_p("".join(sorted(key))) > secrets_scan.token_p(key)
    assert secrets_scan.token_p("internationalization") > 0.01


def test_discoveries_are_weighed_by_length(monkeypatch):
    """Benjamini-Hochberg on P over the length's share, against a plain statement of it."""
    rng = random.Random(3)
    for _ in range(50):
        tokens = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 90))) for _ in range(rng.randrange(1, 12))]
        p = {t: rng.choice([1e-6, 1e-3, 4e-3, 8e-3, 0.02, 0.5]) for t in tokens}
        monkeypatch.setattr(secrets_scan, "token_p", p.__getitem__)
        mean, n = sum(map(len, tokens)) / len(tokens), len(tokens)
        q = sorted((p[t] * mean / len(t), t) for t in tokens)
        k = max((i + 1 for i in range(n) if q[i][0] <= 0.01 * (i + 1) / n), default=0)
        text = " ".join(tokens)
        assert sorted(text[a:b] for a, b in secrets_scan.random_spans(text, [])) == sorted(t for _, t in q[:k])


def test_secret_keys_of_letters_alone(documents):
    """Keys without a digit are found; long compounds of a corpus's words seldom are."""
    rng = random.Random(1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = lambda tokens: sum(secrets_scan.random_spans(f"a key {t} here", []) == [(6, 6 + len(t))] for t in tokens) / len(tokens)
    for letters, least in ((upper + upper.lower(), (0.95, 0.98)), (upper.lower(), (0.75, 0.93)), (upper, (0.75, 0.93))):
        for n, share in zip((20, 40), least, strict=True):
            assert found(["".join(rng.choice(letters) for _ in range(n)) for _ in range(400)]) > share
    pool = [w for _, t in documents for w in re.findall(r"\b[a-z]{2,14}\b", t or "")]
    for join in ("_".join, "-".join, "/".join, "".join, lambda ws: "".join(w.title() for w in ws)):
        tokens = [join(pool[i : i + 6]) for i in (rng.randrange(len(pool) - 6) for _ in range(1000))]
        assert found([t for t in tokens if len(t) >= 20]) < 0.02


def test_sharding_laws(spark, tricky_docs, empty_docs, tricky):
    for docs in (tricky_docs, tricky_docs.repartition(2)):
        got = sharding.feistel_shards(docs).collect()
        assert len(got) == len(tricky) and sorted(r.place for r in got) == list(range(len(tricky))) == sorted(r.row_no for r in got)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert set(by) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    a, b = ({r.doc_id: r.place for r in sharding.feistel_shards(d).where("doc_id not in (11)").collect()} for d in (tricky_docs, tricky_docs.repartition(3)))
    a.pop(None, None), b.pop(None, None)
    assert a == b
    places = [p for _, p in sorted(a.items())]
    assert abs(np.corrcoef(places, range(len(places)))[0, 1]) < 0.2
    other = {r.doc_id: r.place for r in sharding.feistel_shards(tricky_docs, seed=2).collect()}
    assert other != a
    assert sharding.feistel_shards(empty_docs).collect() == []
    for n in (1, 2, 3, 7, 9):
        assert sorted(r.place for r in sharding.feistel_shards(spark.range(n).withColumnRenamed("id", "doc_id")).collect()) == list(range(n))


def test_sharding_places_are_the_permutation(spark, tricky):
    """Every shard and slot recomputed in plain integers."""
    rows = [(i, f"{n}") for n, (i, _, _) in enumerate(tricky) if i != 11]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    n, k = len(rows), int(len(rows) ** 0.5)
    a = (k if k * k == n else k + 1) + 1
    b = -(-n // a)
    keys = [(5 * 7919 + i * 104729 + 12345) % 2**30 for i in range(1, 7)]

    def mixed(x, key):
        x = (x * 1103515245 + key) % 2**31
        return (x ^ x >> 15) * (1299721 + 2 * key % 65536) % 2**31

    def step(x):
        left, right = x % a, x // a
        for i, key in enumerate(keys):
            left, right = ((left + mixed(right, key)) % a, right) if i % 2 == 0 else (left, (right + mixed(left, key)) % b)
        return right * a + left

    order = sorted((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i is not None, i or 0, t) for i, t in rows)
    want = {}
    for x, (_, _, i, t) in enumerate(order):
        p = step(x)
        while p >= n:
            p = step(p)
        want[t] = (p, p % 8, p // 8)
    got = sharding.feistel_shards(docs, seed=5, extra={"t": F.col("text")}).collect()
    assert {r.t: (r.place, r.shard, r.slot) for r in got} == want


def test_sharding_query(spark, documents):
    for r in queries.QUERIES["op8_sharding"](spark, SF).collect():
        text = (dict(documents)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)


PATH = "/opt/tokenizers/byte_bpe_50k.json"
ODD_TEXTS = ["", " ", "  two  spaces ", "\n\n a\n b \n", "tab\tand nbsp  em", "don't we'll THEY'RE i'm", "<|endoftext|> special", "1234567 12.5e-7", "漢字かな交じり文 テスト", "😀😀 👨‍👩‍👧", "x" * 3000, "a" + " b" * 1000, "naïve café — “quotes”…", "word \u0085 next ​ zero​width", "end ", " .,;:!?", "((nested)) [x]{y}", "ß ſ K", "é combining", "\x00\x01 control", "﻿bom"]


def test_token_files_are_the_library(spark, documents, tmp_path):
    rows = documents[:500] + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(docs, PATH, shard_ids=3000).collect())
    assert got == brute.tokens(rows, PATH)


def test_token_files_of_awkward_rows(spark, tricky_docs, empty_docs, tricky):
    got = token_files.token_files(tricky_docs, PATH).collect()
    rows = sorted(((-1 if i is None else i, len(t or ""), t or "") for i, t, _ in tricky))
    want = brute.tokens([((i, n), t) for i, n, t in rows], PATH)
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == Counter((i[0], *x) for i, *x in want)
    assert token_files.token_files(empty_docs, PATH).collect() == []


def test_encoder_knows_pieces_across_calls(documents, monkeypatch):
    """Pieces go to the library once, whatever call or task they came in first; ids are the library's all the same."""
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(PATH), [t for _, t in documents[:300] if t] + ODD_TEXTS + ["a <|endoftext|>b c<|endoftext|> d\ne\n\nf"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]

    def check(encoder, at):
        ids, sizes = encoder.encode([texts[i] for i in at])
        assert sizes.tolist() == [len(want[i]) for i in at] and ids.tolist() == [x for i in at for x in want[i]]

    sent = []
    batch = token_files.Encoder._batch
    monkeypatch.setattr(token_files.Encoder, "_batch", lambda self, some: sent.extend(some) or batch(self, some))
    order = list(range(len(texts)))
    check(token_files.Encoder.of(PATH), order)
    sent.clear()
    check(token_files.Encoder.of(PATH), order[::-1])
    assert len(sent) == len(texts)  # their first pieces, or texts that can't be cut
    monkeypatch.setattr(token_files.Encoder, "LIMIT", 100)
    small = token_files.Encoder(PATH)
    for i in range(0, len(texts), 7):
        check(small, order[i : i + 7])
        assert len(small.names) == len(small.codes) == len(small.uses) <= 100
    small.opens[:] = False  # as if tokens didn't show where a piece begins
    check(small, order)
    assert [len(x) for x in small.encode([])] == [0, 0] and small.encode([""])[1].tolist() == [0]


def test_a_call_takes_memory_of_its_own_size(monkeypatch, tmp_path):
    """However many pieces a worker knows, no table is built over them, and each call's memory goes before the next."""
    import pyarrow as pa
    from pyspark import TaskContext

    encoder = token_files.Encoder(PATH)
    encoder.encode([" ".join(f"n{i}" for i in range(200_000))])
    pool = pa.proxy_memory_pool(pa.system_memory_pool())
    monkeypatch.setattr(token_files.Encoder, "_loaded", {})
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        ids, _ = encoder.encode(["one n5 new n199999"])
    finally:
        pa.set_memory_pool(before)
    assert ids.tolist() == encoder.lib.encode("one n5 new n199999", add_special_tokens=False).ids
    assert pool.max_memory() < 2 * (encoder.names.nbytes + encoder.codes.nbytes)
    del ids, encoder  # before the pool that holds them

    calls = []
    encode, back = token_files.Encoder.encode, token_files.give_back
    monkeypatch.setattr(token_files.Encoder, "encode", lambda self, texts: calls.append("encode") or encode(self, texts))
    monkeypatch.setattr(token_files, "give_back", lambda: calls.append("give back") or back())
    monkeypatch.setattr(token_files, "CALL_CHARS", 10)
    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 0})())
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a long first text", "a long second text", "a third"])], names=["doc_id", "text"])
    assert sum(b.column("n")[0].as_py() for b in token_files._write(f"file://{tmp_path}", PATH, 2, 1 << 20)([rows])) > 3
    assert calls == ["encode", "give back"] * 3


def test_tasks_give_memory_back(monkeypatch):
    """Rows pass as they are; what a task held is free when memory is handed back, and then is the system's again."""
    import weakref

    import pyarrow as pa

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) / 1024

    class Cache(dict):
        pass

    caches = []

    def run(batches):
        cache = Cache()
        caches.append(weakref.ref(cache))
        cache[0] = [pa.array(np.arange(1000)).take(pa.array(np.arange(1000))) for _ in range(20_000)]  # 160 MB
        yield from batches

    give_back, alive = trimmed.__globals__["give_back"], []
    monkeypatch.setitem(trimmed.__globals__, "give_back", lambda: alive.append(caches[-1]()) or give_back())
    before, rows = held(), trimmed(run)(iter([1, 2]))
    assert next(rows) == 1 and held() > before + 100 and list(rows) == [2]
    assert alive == [None] and held() < before + 50


def test_wavelet_matrix():
    rng = np.random.default_rng(6)
    for ids in (rng.integers(0, 50_000, 9000), rng.integers(0, 3, 5000) * 7, np.full(10, 4), np.array([], dtype=int), rng.integers(0, 1 << 31, 4097)):
        ids = ids.astype(np.uint32)
        m = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids).to_bytes())
        assert (m.decode() == ids).all() and m.n == len(ids)
        for i in rng.integers(0, max(len(ids), 1), 30) if len(ids) else []:
            token = int(ids[i])
            where = np.flatnonzero(ids == token)
            assert m.access(int(i)) == token and m.count(token) == len(where)
            assert m.rank(token, int(i)) == int((where < i).sum())
            j = int(rng.integers(0, len(where)))
            assert m.select(token, j) == where[j]
        assert m.count(123_456_789) == 0


def test_toxicity_on_held_out_rows(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    labels = dict(zip(*[pq.read_table(f"{sf}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")], strict=True))
    got = queries.QUERIES["op6_toxicity"](spark, sf).collect()
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    right = np.mean([(s >= 0.5) == y for s, y in held])
    assert auc > 0.94 and right > 0.98, (auc, right)


def test_toxicity_spans_and_awkward_rows(spark, tricky_docs, empty_docs, tricky):
    rng = random.Random(8)
    bad = ["grubfarn", "slodgewit"]
    rows = []
    for i in range(200):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 90))]
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(len(w))] = f"{rng.choice(bad).upper()}!"
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    for r in toxicity.toxicity(docs, labels, spans=True).collect():
        _, text, y = rows[r.doc_id]
        assert r.predicted == y
        assert [text[s.start : s.end].strip("!").lower() in bad for s in r.spans] == [True] * y
    got = toxicity.toxicity(tricky_docs, labels).collect()
    assert len(got) == len(tricky) and all(0 <= r.score <= 1 for r in got)  # some ids of this table are labelled, and trained on
    assert toxicity.toxicity(empty_docs, labels).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity.toxicity(docs, none).collect())


def test_marginals_are_exact():
    """Forward-backward against the sum over all labelings."""
    import itertools

    rng = np.random.default_rng(0)
    crf = toxicity.Crf(enter=0.4, leave=-0.7, stay=1.1)
    lengths = [7, 0, 1, 5]
    e = rng.normal(size=sum(lengths))
    fwd, bwd = toxicity.passes(e, lengths, crf)
    at = 0
    for n in lengths:
        p, own = (fwd * bwd / (1 + fwd * bwd))[at : at + n], e[at : at + n]
        at += n
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(own[t] for t in range(n) if y[t]) + sum({(0, 0): 0, (0, 1): crf.enter, (1, 0): crf.leave, (1, 1): crf.stay}[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            ones += w * np.array(y)
        assert p == pytest.approx(ones / total, abs=1e-9)


def plain_marginals(e, crf):
    """One chain, word by word, in logarithms."""
    add = np.logaddexp
    a, b = [(0.0, e[0])], [(0.0, 0.0)]
    for x in e[1:]:
        zero, one = a[-1]
        a.append((add(zero, one + crf.leave), x + add(zero + crf.enter, one + crf.stay)))
    for x in e[:0:-1]:
        zero, one = b[-1]
        b.append((add(zero, one + x + crf.enter), add(zero + crf.leave, one + x + crf.stay)))
    total = add(*a[-1])
    return np.array([np.exp(f[1] + g[1] - total) for f, g in zip(a, b[::-1], strict=True)])


def test_chains_are_whole_documents(spark):
    """Scores and spans of documents of any length, against a chain taken word by word; state crosses every block."""
    rng = random.Random(12)
    crf = toxicity.Crf({"=bad": 5.0, "^wor": 2.0}, bias=-3.0, enter=-0.5, leave=-2.0, stay=2.5, final=(1.0, 2.0, 0.5, -2.5))
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "Bad!", "x"] if i % 2 else ["fine", "x", "y", "worse"]) for _ in range(n)) for i, n in enumerate((0, 1, 2, 63, 64, 65, 128, 129, 700, 5000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in toxicity.score(docs, crf).collect():
        words = texts[r.doc_id].split()
        e = [crf.emission(w.lower().strip(toxicity.STRIP)) for w in words]
        p = plain_marginals(e, crf) if e else np.zeros(0)
        x = np.array([np.log1p(p.sum()), p.max(initial=0), np.log1p((p > 0.5).sum())])
        assert r.score == pytest.approx(1 / (1 + np.exp(-(x @ crf.final[:3] + crf.final[3]))), abs=1e-9)
        at = [m.span() for m in re.finditer(r"\S+", texts[r.doc_id])]
        assert [(s.start, s.end) for s in r.spans] == [at[i] for i in np.flatnonzero(p > 0.5)]
    long = np.concatenate([np.full(100, -1.0), np.full(60, 3.0), np.full(200, -1.0)])
    fwd, bwd = toxicity.passes(long, [len(long)], crf)
    assert fwd * bwd / (1 + fwd * bwd) == pytest.approx(plain_marginals(long, crf), abs=1e-9)


def test_toxicity_trains_on_whole_texts(spark):
    """Words that stand late in long texts mark them."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        w = [f"w{rng.randrange(300)}" for _ in range(2500)]
        if i % 3 == 0:
            w[-1 - rng.randrange(50)] = "grubfarn"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {i: y for i, _, y in rows}


def test_training_takes_documents_in_parts(monkeypatch):
    """Memory doesn't follow the words of all documents, and the parts don't change the field."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 2000, 6000 + k)) + (" vile slur" * (k % 4 == 0)) for k in range(200)]
    docs = [(t, int(k % 4 == 0)) for k, t in enumerate(texts)]
    tracemalloc.start()
    whole = toxicity.train(docs, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.weights and peak < 90e6  # 1.2 million words
    monkeypatch.setattr(toxicity, "CALL_WORDS", 7000)
    parts = toxicity.train(docs, steps=2)
    assert parts.weights == pytest.approx(whole.weights) and parts.bias == pytest.approx(whole.bias) and parts.final == pytest.approx(whole.final)
    assert (parts.enter, parts.leave, parts.stay) == pytest.approx((whole.enter, whole.leave, whole.stay))


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions on its own input, against plain implementations."""
    from test_dedup import plain_leaks

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        seen.append((name, docs, out))
        docs = out
    assert [s[0] for s in seen] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    assert all(out.columns == columns for _, _, out in seen[:-1])
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    crf = toxicity.fit(seen[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    fine = set()
    for i, text in pairs(seen[0][1]):
        p = plain_marginals([crf.emission(w.lower().strip(toxicity.STRIP)) for w in text.split()], crf) if text and text.split() else np.zeros(0)
        x = np.array([np.log1p(p.sum()), p.max(initial=0), np.log1p((p > 0.5).sum())])
        fine |= {i} if x @ crf.final[:3] + crf.final[3] < 0 else set()
    assert {i for i, _ in pairs(seen[0][2])} == fine and len(fine) < seen[0][1].count()
    near = brute.near(pairs(seen[1][1]), 5)
    assert sorted(i for i, _ in pairs(seen[1][2])) == sorted(i for i, (_, c) in near.items() if i == c)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, _ in plain_leaks(pairs(seen[2][1]), bench)}
    assert sorted(i for i, _ in pairs(seen[2][2])) == sorted(i for i, _ in pairs(seen[2][1]) if i not in gone)
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in seen[3][1].collect()]
    copies, _ = plain_mix(rows, plain_targets([r[1:] for r in rows])[1])
    assert Counter(i for i, _ in pairs(seen[3][2])) == Counter({i: n for i, n in copies.items() if n})
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in seen[4][2].collect())
    want = brute.tokens(pairs(seen[4][1]), PATH)
    assert got == sorted((s, i, n, c) for i, s, n, c in want)


def test_pipeline_stages_on_awkward_tables(spark, tricky_docs, empty_docs):
    docs = tricky_docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, SF).count() == 0
        out = materialize(stage(spark, docs, SF))
        if name != "token_files":
            assert out.columns == docs.columns and 0 < out.count()
        if name == "near_dedup":
            ids = Counter(r.doc_id for r in out.select("doc_id").collect())
            assert ids[11] == 1 and ids[None] == 2  # one of the repeated rows, and all without an id
        docs = out
    assert docs.where(F.col("doc_id").isNull()).count() > 0
