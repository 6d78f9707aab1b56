"""The operators for training data against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from oracle_check import compare, connect
from tracklight.llm import (
    decontaminate,
    lm_scoring,
    mixing,
    multiset_hash,
    pii,
    quality_gam,
    queries,
    secret_scan,
    simhash,
    suffix_dedup,
    toxicity,
)
from tracklight.llm.common import in_fold, table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, score string, _key long, spans string, size int, print string"
LONG = " ".join(f"w{i % 700}" for i in range(60_000))
AWKWARD = [
    (1, "one two three four five"), (2, None), (3, ""), (None, "no id here at all"), (4, " \t\n"),
    (5, "same words again"), (5, "same words again"), (6, LONG), (7, LONG), (None, None), (8, "ä ö ü 漢字"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None, "s" if (i or 0) % 2 else None, "x", 1, "x", 2, "x") for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ascii_words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql_answers(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name) is None


# Mixing ---------------------------------------------------------------------------------------


def mixed(docs, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, size, taken) by going through the sources one after the other."""
    sized = [(d, s, len(ascii_words(t))) for d, t, s in docs]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {n: sum(k for _, s, k in sized if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    stopped = set()
    while True:
        rest = share * sum(size.values()) - sum(most * size[n] for n in stopped)
        free = sum(weight[n] for n in names if n not in stopped)
        level = rest / free if free else 0
        over = {n for n in names if n not in stopped and level * weight[n] > most * size[n]}
        if not over:
            break
        stopped |= over
    out = []
    for n in names:
        target = most * size[n] if n in stopped else level * weight[n]
        budget = math.floor(target)
        order = sorted(
            (hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest(), d or 0, k, d)
            for d, s, k in sized if s == n
        )
        taken = [0] * len(order)
        while budget > 0:
            for i, (_, _, k, _) in enumerate(order):
                step = min(k, budget)
                taken[i] += step
                budget -= step
        out += [(d, k, t) for (_, _, k, d), t in zip(order, taken)]
    return out


def test_mix_against_brute_force(spark, awkward, nothing):
    docs = table(spark, SMALL, "documents")
    for df in (docs, awkward):
        got = rows_of(mixing.mix(df).select("doc_id", "size", "taken"))
        want = mixed(rows_of(df.select("doc_id", "text", "source")))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert mixing.mix(nothing).count() == 0


def test_mixed_rows_follow_the_mix(spark, awkward, nothing):
    for df in (table(spark, SMALL, "documents"), awkward):
        digest = Counter()
        for r in mixing.mix(df).collect():
            digest[r.doc_id, r.source] += r.taken
        rows = mixing.mixed(df).collect()
        assert set(mixing.mixed(df).columns) == {*df.columns, "epoch", "taken"}
        assert all(r.taken == len(ascii_words(r.text)) > 0 for r in rows)
        texts = {}
        for r in df.collect():
            texts.setdefault((r.doc_id, r.source), []).append(r.text or "")
        got = Counter()
        for r in rows:
            assert any(t.startswith(r.text) for t in texts[r.doc_id, r.source])
            got[r.doc_id, r.source] += r.taken
        assert got == +digest and max(r.epoch for r in rows) == 2
    assert sum(r.text not in texts[r.doc_id, r.source] for r in rows) > 0  # some are cut
    assert mixing.mixed(nothing).count() == 0


def test_last_stage_gives_the_mixed_texts(spark):
    docs = table(spark, SMALL, "documents")
    corpus = corpus_pipeline.mixture(spark, docs, SMALL)
    assert {*docs.columns, "epoch", "taken"} == set(corpus.columns)
    got = rows_of(mixing.taken_words(docs, corpus).select("doc_id", "size", "taken"))
    assert sorted(got) == sorted(mixed(rows_of(docs.select("doc_id", "text", "source"))))
    assert any(t == 0 for _, _, t in got) and corpus.where("taken = 0 OR n_chars <> length(text)").count() == 0


CLASHING = ("target", "source_size", "_place", "_start", "_epochs", "_partly", "_s", "_size", "Size", "_range", "Epoch",
            "_doc", "_clean", "clean", "found", "new_text", "N_Hex", "_before", "_sum")


def test_other_columns_may_have_any_name(spark):
    rows = [(i, f"some words of text {i} a@b{i}.org", "s", *range(len(CLASHING))) for i in range(6)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    mix = mixing.mixed(docs)
    assert set(mix.columns) == {*docs.columns, "epoch", "taken"} - {"Epoch"}
    clean, named = secret_scan.without_secrets(docs), pii.pseudonymised(docs)
    assert clean.columns == docs.columns and {"n_entities", "spans", "text"} <= set(named.columns)
    for df, gone in ((mix, {"Epoch"}), (clean, set()), (named, {"found"})):
        for c in set(CLASHING) - gone:
            assert {r[0] for r in df.select(f"`{c}`").collect()} == {CLASHING.index(c)}, c
    assert mixing.mix(docs).count() == secret_scan.scan_documents(docs).count() == 6


def test_mixed_texts_stay_where_they_are_read(spark):
    """Texts go through no shuffle, also where no table is small enough to be sent without being asked."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = mixing.mixed(table(spark, SMALL, "documents"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Join" in plan and not any(step in plan for step in ("hashpartitioning", "Sort", "Window"))


@pytest.mark.parametrize("most_sent", [mixing.MOST_SENT, (0, 0)])
def test_mix_ends_among_rows_alike(spark, monkeypatch, most_sent):
    """Rows of one id and size among which the last epoch ends, each with a text of its own."""
    monkeypatch.setattr(mixing, "MOST_SENT", most_sent)
    rows = [(None, f"no id {i} x", s) for i in range(15) for s in ("a", None)]
    rows += [(7, f"one {i}", "b") for i in range(11)] + [(None, None, "b"), (8, "", "b"), (9, " ", "empty")]
    rows += [(i % 3, f"w{i} " * (i % 4), "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 0.71, 1.5):
        corpus = rows_of(mixing.mixed(docs, share=share))
        size, taken = Counter(), Counter()
        for d, t, s, _, n in corpus:
            assert n == len(ascii_words(t)) > 0
            assert any((d, s) == (e, z) and (u or "").startswith(t) for e, u, z in rows)
            taken[d, n] += 1
            size[d] += n
        want = Counter()
        for d, _, n in mixed(rows, share=share):
            want[d] += n
        assert size == +want
        parts = {(d, k): (t // k, t % k) for d, k, t in mixed(rows, share=share) if k and t % k}
        assert parts and all(taken[d, part] > 0 for (d, _), (_, part) in parts.items())
        again = mixing.mixed(docs.repartition(3), share=share)
        assert Counter(corpus) == Counter(rows_of(again))


# Substring dedup ------------------------------------------------------------------------------


def without_repeats(docs):
    first, out = {}, []
    split = [(d, ascii_words(t)) for d, t in docs]
    for d, w in split:
        for s in range(len(w) - 19 if d is not None else 0):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (d, s)), (d, s))
    stays = set(first.values())
    for d, w in split:
        gone = set()
        for s in range(len(w) - 19 if d is not None else 0):
            if (d, s) not in stays:
                gone.update(range(s, s + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4096, 3])
def test_suffix_dedup_against_brute_force(spark, awkward, nothing, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "TREE_SUFFIXES", limit)
    monkeypatch.setattr(suffix_dedup, "LOCAL_PLACES", limit)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ANCHORS", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK_SUFFIXES", 50)
    rng = random.Random(limit)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for d in range(60):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((d if d % 11 else None, " ".join(w)))
    docs += [(100, "z " * 200), (101, "z " * 50), (7, docs[8][1]), (102, docs[8][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for frame in (df, awkward):
        got = rows_of(suffix_dedup.dedup(frame).drop("spans"))
        want = without_repeats(rows_of(frame.select("doc_id", "text")))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_dedup.dedup(nothing).count() == 0


def test_suffix_dedup_spans(spark):
    w = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "new " + " ".join(w[2:28]) + " end")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in suffix_dedup.dedup(df).collect()} == {1: [], 2: [[1, 27]]}


# Fingerprints ---------------------------------------------------------------------------------


def test_fingerprints_add_up(spark):
    a, b = "first line here\nsecond", "third line of words"
    texts = [(a + "\n" + b, "x"), (b + "\n" + a, "y"), (a, "a"), (b, "b")]
    df = multiset_hash.with_fingerprint(spark.createDataFrame(texts, "text string, k string"), "text", "p")
    p = {r.k: r.p for r in df.collect()}
    assert p["x"] == p["y"] != p["a"]
    pairs = spark.createDataFrame([(p["a"], p["b"], p["x"])], "a array<long>, b array<long>, x array<long>")
    both = multiset_hash.combined(pairs.a, pairs.b)
    less = multiset_hash.combined(pairs.x, pairs.b, -1)
    assert tuple(pairs.select(both == pairs.x, less == pairs.a).first()) == (True, True)


def test_fingerprints_of_edited_texts(spark, awkward, nothing):
    for df in (table(spark, SMALL, "documents"), awkward):
        got = multiset_hash.fingerprints(df).collect()
        rows = sorted(
            ((d, t or "") for d, t in rows_of(df.select("doc_id", "text"))),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
        )
        want = []
        for i, (d, t) in enumerate(rows):
            n = len(t) // 4
            edited = t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]
            want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {r.doc_id: r.fingerprint for r in got}
    assert by_text[6] == by_text[7] and by_text[2] == by_text[3] != by_text[1]
    likeness = multiset_hash.fingerprints(table(spark, SMALL, "documents")).toPandas()
    assert likeness.near_edited.mean() > 0.6 and likeness.near_next.mean() < 0.2
    assert multiset_hash.fingerprints(nothing).count() == 0


def test_ring_over_many_ranges(spark):
    ids = random.Random(1).sample(range(10**12), 3000) + list(range(2000))
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = dict(rows_of(multiset_hash.with_next(df, ["doc_id", "text"]).select("doc_id", "next_doc_id")))
    order = sorted(ids)
    assert got == dict(zip(order, order[1:] + order[:1]))


# Personal data --------------------------------------------------------------------------------


def test_surrogates_keep_apart_and_keep_form():
    for digits in (1, 2, 3):
        all_ = [f"{i:0{digits}d}" for i in range(10**digits)]
        assert sorted(pii._reformed(x, "t", b"k") for x in all_) == all_
    cards = [f"411111111111{i:04d}" for i in range(10_000)]
    assert len({pii.surrogate("card", c) for c in cards}) == len(cards)
    for names in (pii.FEMALE, pii.MALE):
        assert {pii._name(n, b"k") for n in names} == set(names)
    forms = {
        "email": "bo.st42@mail8.example.com", "phone": "+1 (988) 555-2485", "ip": "42.144.35.254",
        "card": "4111 1111 1111 1111", "iban": "DE89370400440532013000", "ssn": "123-45-6789", "person": "Mrs. Анна Müller",
    }
    for kind, text in forms.items():
        assert pii.entities(f"so {text}, yes") == [(3, 3 + len(text), kind)]
        new = pii.surrogate(kind, text)
        assert new != text and pii.entities(f"so {new}, yes")[0][2] == kind
        assert new == pii.surrogate(kind, text) != pii.surrogate(kind, text, b"other")
        if kind != "ip":
            shape = lambda x: [(c.isdigit(), c.isalpha(), c.isupper(), c.isascii()) for c in x]
            assert shape(new)[1:] == shape(text)[1:] or kind == "person"


def test_names_go_on_and_other_forms_are_found():
    text = "Peter Smith wrote. Mr. Peter Smith came; Smith, not Smithson, left with Peter Smith."
    new, found = pii.replaced(text)
    assert [f[3] for f in found] == ["Peter Smith", "Mr. Peter Smith", "Smith", "Peter Smith"]
    name = pii.surrogate("person", "Mr. Peter Smith")[4:]
    assert new == f"{name} wrote. Mr. {name} came; {name.split()[1]}, not Smithson, left with {name}."
    iban, closed = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    for after in (" now", ", OK", " AB CD", ""):
        assert pii.entities(f"to {iban}{after}") == [(3, 3 + len(iban), "iban")]
    other = pii.surrogate("iban", iban)
    assert other.replace(" ", "") == pii.surrogate("iban", closed) and pii.entities(other) == [(0, len(iban), "iban")]
    assert pii.entities("AB12 4111 1111 1111 1111 x")[0][2] == "card"
    for ip in ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1", "::ffff:10.0.0.1", "2001:DB8::aF1"):
        assert pii.entities(f"at {ip}, yes") == [(3, 3 + len(ip), "ip")]
        new = pii.surrogate("ip", ip)
        assert new != ip and pii.entities(new) == [(0, len(new), "ip")]
    assert pii.entities("at 12:30:45 std::vector a::b 10:20 ::") == []


def test_long_runs_without_a_sign_are_passed_over():
    start = time.time()
    for text in ("x" * 300_000, "x" * 300_000 + "@", "@" + "x" * 300_000, "a@" * 50_000, "1" * 300_000, "A1" * 150_000):
        pii.entities(text)
    assert time.time() - start < 20
    assert pii.entities("x" * 5_000 + "@mail.org") == [(0, 5_009, "email")]


def test_surrogates_of_documents(spark, awkward, nothing):
    rows = [(1, "mail a.b@c.org and a.b@c.org or 10.0.0.1"), (2, "a.b@c.org"), (3, None)]
    got = rows_of(pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "n_entities", "spans"))
    by = {d: (t, n, s) for d, t, n, s in got}
    new = pii.surrogate("email", "a.b@c.org")
    assert by[1] == (f"mail {new} and {new} or {pii.surrogate('ip', '10.0.0.1')}", 3, "email:5:14,email:19:28,ip:32:40")
    assert by[2][0] == new and by[3] == (None, 0, "")
    kept = rows_of(pii.pseudonymised(awkward).select("doc_id", "text"))
    assert sorted(kept, key=repr) == sorted(AWKWARD, key=repr)
    assert pii.pseudonymised(nothing).count() == 0 and pii.collisions(pii.detected(awkward)).count() == 0


# SimHash --------------------------------------------------------------------------------------


def fingerprint(text):
    w = ascii_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def grouped(prints):
    """The smallest id that each (id, fingerprint) can reach."""
    kinds = sorted({p for _, p in prints})
    label = {p: p for p in kinds}

    def top(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, p in enumerate(kinds):
        for q in kinds[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                a, b = top(p), top(q)
                label[max(a, b)] = min(a, b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return [(d, f"{p:016x}", least.get(top(p))) for d, p in prints]


def test_simhash_against_brute_force(spark, awkward, nothing, monkeypatch):
    for df in (table(spark, SMALL, "documents"), awkward):
        got = rows_of(simhash.near_groups(df))
        want = grouped([(d, fingerprint(t)) for d, t in rows_of(df.select("doc_id", "text"))])
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_groups(nothing).count() == 0
    kept = rows_of(simhash.one_of_each(awkward).select("doc_id"))
    assert sorted(kept, key=repr) == sorted([(1,), (2,), (None,), (5,), (6,), (8,), (None,)], key=repr)


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_of_close_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 100)
    rng = random.Random(3)
    prints = set()
    for _ in range(20):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    got = simhash.components(simhash.links(df)).collect()
    roots = {r.node: r.root for r in got}
    want = {d: c for d, _, c in grouped(list(enumerate(prints)))}
    same = {}
    for i, p in enumerate(signed):
        same.setdefault(roots.get(p, p), set()).add(i)
    assert {min(g): g for g in same.values()} == {c: {i for i in want if want[i] == c} for c in set(want.values())}


def test_bit_sliced_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.concatenate([base ^ np.uint64(m) for m in (0, 1, 7, 31, 63, 1 << 40)])
    buckets = np.sort(rng.integers(0, 5, len(prints)))
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(prints, buckets) for i, j in zip(a, b)}
    want = {
        (i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))
        if buckets[i] == buckets[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 4
    }
    assert got == want


# Near-dedup of the pipeline -------------------------------------------------------------------


def test_near_stage_keeps_one_of_each_group(spark, awkward, nothing):
    docs = table(spark, SMALL, "documents")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).select("doc_id").collect()}
    prints = [(d, fingerprint(t)) for d, t in rows_of(docs.select("doc_id", "text"))]
    assert kept == {c for _, _, c in grouped(prints)} and len(kept) < len(prints)
    got = rows_of(corpus_pipeline.near_dedup(spark, awkward, SMALL).select("doc_id"))
    assert sorted(got, key=repr) == sorted([(1,), (2,), (None,), (5,), (6,), (8,), (None,)], key=repr)
    assert corpus_pipeline.near_dedup(spark, nothing, SMALL).count() == 0


# Secrets --------------------------------------------------------------------------------------


def test_secret_spans():
    text = "Password='abc123' token: ab key AKIA" + "Z9" * 9 + " 0123456789abcdef0123456789 é API_KEY=xY"
    assert secret_scan.base_spans(text) == [
        (0, 16, "assign"), (32, 54, "access"), (55, 81, "hex"),
    ]
    # A short value is dropped, but its match is used up.
    assert secret_scan.base_spans("password: token: abcdefgh") == []
    assert secret_scan.scan("")["base"] == ""


def test_entropy_windows_against_brute_force():
    rng = random.Random(9)
    for alphabet in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCdef012+/", "aA1"):
        for _ in range(30):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 60)))
            want = []
            for i in range(len(s) - 19):
                w = s[i : i + 20]
                bits = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
                digits, low, up = (sum(f(c) for c in w) for f in (str.isdigit, str.islower, str.isupper))
                other = 20 - digits - low - up
                beyond = any(c.lower() in "ghijklmnopqrstuvwxyz" for c in w)
                least = None
                if digits >= 2 and low + up >= 2:
                    least = 3.7 if low and up else None if other else 3.4 if beyond else 3.0
                if least is not None and bits >= least - 1e-12:
                    want.append(i)
            assert [i for i in secret_scan._random_windows(s)] == want
    assert secret_scan.entropy_spans("id 123e4567-e89b-12d3-a456-426614174000 end") == []


def test_allowed_words_hide_only_what_they_touch():
    key = "f8Kd92LmQz71XcVb40NsTy5R"
    for text in (f"deploy/example/{key}", f"{key}/sample", f"a=placeholder/{key}=01234567", f"sha1=deploy/{key}"):
        at = text.index(key)
        spans = secret_scan.entropy_spans(text)
        assert [(max(s, at), min(e, at + len(key))) for s, e in spans] == [(at, at + len(key))]
        assert key not in secret_scan.masked(text)
    assert secret_scan.entropy_spans("f8Kd92LmQz7exampleXcVb40NsTy5R") == []
    digest = hashlib.sha256(b"x").hexdigest()
    for text in ("123e4567-e89b-12d3-a456-426614174000", f"sha256-{digest}", "sha1-" + "Kd92LmQz71XcVb40NsTy5Rf8Kd9="):
        assert secret_scan.entropy_spans(text) == []


def test_secret_documents(spark, awkward, nothing):
    got = secret_scan.scan_documents(awkward).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_assign, r.spans, r.base_sha256) for r in got} == {(0, "", empty)} and len(got) == len(AWKWARD)
    df = spark.createDataFrame([(1, "x token=abcdef12 y"), (2, None)], "doc_id long, text string")
    assert rows_of(secret_scan.without_secrets(df)) == [(1, "x [assign] y"), (2, None)]
    assert secret_scan.scan_documents(nothing).count() == 0


# Decontamination ------------------------------------------------------------------------------


def test_tiling_finds_reordered_passages(spark, nothing, awkward):
    item = [f"q{i}" for i in range(40)]
    docs = [
        (1, "start " + " ".join(item[20:] + ["gap"] + item[:20]) + " end"), (2, " ".join(item[:18]) + " cut"),
        (3, " ".join(item[:22])), (4, " ".join(item[i] for i in range(0, 40, 2))), (5, " ".join(w.upper() for w in item)),
    ]
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (1 << 20, 100):
        got = sorted(rows_of(decontaminate.leaks(df, items, block_bytes=size)))
        assert got == [(1, 7, 1.0, 2, 20), (3, 7, 0.55, 1, 22), (5, 7, 1.0, 1, 40)]
        assert [r.doc_id for r in decontaminate.without_leaks(df, items, block_bytes=size).collect()] == [2, 4]
    assert decontaminate.leaks(nothing, items).count() == 0
    assert decontaminate.leaks(df, items.limit(0)).count() == 0
    assert decontaminate.leaks(awkward, items).count() == 0


def test_tiles_against_plain_greedy_tiling():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item = rng.integers(1, 5, rng.integers(5, 25)).astype(np.int32)
        text = rng.integers(1, 5, rng.integers(5, 60)).astype(np.int32)
        own, other = decontaminate._seeds(text), decontaminate._seeds(item)
        pairs = np.argwhere(own[:, None] == other[None, :])
        got = decontaminate.tiles(text, item, pairs[:, 0], pairs[:, 1])
        marked, used, want = [False] * len(text), [False] * len(item), []
        while True:
            best = None
            for p in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while (
                        p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n]
                        and not used[p + n] and not marked[t + n]
                    ):
                        n += 1
                    if n >= 5 and (best is None or n > best[2]):
                        best = (t, p, n)
            if best is None:
                break
            want.append(best)
            t, p, n = best
            marked[t : t + n] = [True] * n
            used[p : p + n] = [True] * n
        assert got == want


# Models ---------------------------------------------------------------------------------------


def test_quality_held_out(spark, awkward, nothing):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = quality_gam.train(docs, labels)
    scored = quality_gam.score_documents(docs.select("doc_id", "text"), model)
    held = scored.where(in_fold("doc_id", 5, 0)).join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97
    got = quality_gam.score_documents(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.accepted(nothing, model).count() == 0
    constant = quality_gam.train(docs, labels.limit(0))
    assert {r.score for r in quality_gam.score_documents(awkward, constant).collect()} == {0.5}


def test_toxicity_held_out(spark, awkward, nothing):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    held = scored.where(in_fold("doc_id", 4, 2)).join(labels, "doc_id").toPandas()
    assert held.predicted[held.toxic == 1].mean() > 0.85 and held.predicted[held.toxic == 0].mean() < 0.05
    got = toxicity.score_documents(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(nothing, model).count() == 0
    constant = toxicity.train(docs, labels.limit(0))
    assert len({r.score for r in toxicity.score_documents(awkward, constant).collect()}) == 1


def test_lm_scores(spark, awkward, nothing):
    target = awkward.where("doc_id = 6").select("doc_id")
    got = {r.doc_id: r for r in lm_scoring.score_documents(awkward, target).collect()}
    assert got[6].difference == got[7].difference < got[1].difference
    assert tuple(got[2])[1:] == (0, 0.0, 0.0, 0.0) and got[6].n_words == 60_000
    assert lm_scoring.score_documents(nothing, target).count() == 0


def test_lm_scores_with_most_words_looked_up_by_the_join(spark, awkward):
    target = spark.createDataFrame([(6,), (7,), (None,)], "doc_id long")

    def rounded(**bounds):
        scored = lm_scoring.score_documents(awkward, target, size=4, **bounds)
        return sorted(((r[0] or 0, r[1], *(round(x, 6) for x in r[2:])) for r in scored.collect()))

    assert rounded(near_words=2) == rounded()
    assert len(rounded()) == len(AWKWARD)


def test_lm_losses_grow_with_the_vocabulary(spark):
    """Every word counts: a text of words that only its kind has is nearer to the target of that kind."""
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + k) % 50}" for k in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.where("doc_id % 2 = 0 AND doc_id < 30").select("doc_id")
    scored = lm_scoring.score_documents(docs, target, size=2, near_words=5).where("doc_id >= 30").collect()
    near, far = ([r.difference for r in scored if r.doc_id % 2 == kind] for kind in (0, 1))
    assert max(near) < min(far)


# Pipeline -------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark):
    docs = table(spark, SMALL, "documents")
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").collect()]
    model = quality_gam.train(docs, table(spark, SMALL, "labels"))
    rows = [r.asDict() for r in docs.collect()]
    scores = model.scores(np.array([quality_gam.features(r["text"].encode()) for r in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= quality_gam.THRESHOLD]
    groups = {d: c for d, _, c in grouped([(r["doc_id"], fingerprint(r["text"])) for r in rows])}
    rows = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    block = decontaminate.block_of(items)
    rows = [r for r in rows if not decontaminate.matches(r["text"].encode(), block, decontaminate.COVERAGE)]
    want = mixed([(r["doc_id"], secret_scan.masked(r["text"]), r["source"]) for r in rows])
    got = rows_of(corpus_pipeline.run(spark, SMALL).select("doc_id", "size", "taken"))
    assert sorted(got) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_pipeline_of_nothing(spark):
    empty = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, SMALL).count() == 0


def test_the_mix_keeps_no_copy_of_the_texts(spark, monkeypatch):
    kept, checkpointed = [], mixing.checkpointed
    monkeypatch.setattr(mixing, "checkpointed", lambda df: kept.append(df.columns) or checkpointed(df))
    assert mixing.mixed(table(spark, SMALL, "documents")).count() > 0
    assert kept and not any("_doc" in columns for columns in kept)
