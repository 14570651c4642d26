"""Operators that SQL cannot express, against plain versions of them on small tables."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import langid, licences, mixing, pii, quality, sharding
from tidemark.llm.textkernel import TOKENS, Words


def _long(n, seed):
    return seed if n is None else xxhash.xxh64_intdigest(struct.pack("<q", n - (1 << 64) if n >= 1 << 63 else n), seed=seed)


def _text(t, seed=42):
    return seed if t is None else xxhash.xxh64_intdigest(t.encode(), seed=seed)


def _int(n, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", n), seed=seed)


# ---- 1: mixing ----


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def _mix(rows, weights=(5, 2, 1), share=1.5, most=2.0, seed=17):
    """Per row (doc_id, text, source): source size, target, copies."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += _size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        over = [s for s in order if s in open_ and budget * weight[s] / total >= most * sizes[s]]
        for s in over or open_:
            target[s] = most * sizes[s] if over else budget * weight[s] / total
        if not over:
            break
        budget -= sum(target[s] for s in over)
        open_ -= set(over)
    out = {}
    for source in order:
        own = [(_int(seed, _long(_text(text), _long(i, 42))) & ((1 << 48) - 1), i is not None, i or 0, _text(text), _size(text), at) for at, (i, text, s) in enumerate(rows) if s == source]
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, before = target[source] - whole * sizes[source], 0
        for *_, size, at in sorted(own):
            more = rest > 0 and before + size / 2 <= rest
            out[at] = (sizes[source], target[source], whole + more)
            before += size
    return out


def test_mixing(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("w" * rnd.randint(0, 30)) or rnd.choice([None, ""]), rnd.choice(["a"] * 9 + ["b", "c", "é", None, "Z"])) for i in range(900)]
    rows += [(None, f"{j} w w", "a") for j in range(5)] + [(7, "other text of seven", "b")]
    want, got = _mix(rows), mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    told = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies, r.taken) for r in got)
    assert told == Counter((i, _size(t), want[k][0], round(want[k][1], 6), want[k][2], want[k][2] * _size(t)) for k, (i, t, _) in enumerate(rows))


def test_a_source_at_its_cap_gives_nothing_more(spark):
    rows = [(i, "w w w" if i % 4 else "", "a" if i < 400 else "b") for i in range(440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 50)).collect()
    capped = [r for r in got if r.doc_id >= 400]
    assert {r.target for r in capped} == {2 * 90.0} and {r.copies for r in capped} == {2}
    assert mixing.mixed_documents(docs, weights=(1, 50)).filter("doc_id >= 400").count() == 80


@pytest.mark.parametrize("places", [1, 5])
def test_equal_rows_are_split_exactly(spark, places):
    rows = [(1, "one two three four", "a")] * 700 + [(2, "x y", "a"), (3, "z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(places)
    got = [r for r in mixing.mix(docs, weights=(3, 1), share=1.2).collect() if r.doc_id == 1]
    copies = Counter(r.copies for r in got)
    assert len(got) == 700 and set(copies) == {1, 2} and abs(copies[2] * 4 - (got[0].target - got[0].source_size)) <= 4


def test_many_sources_are_filled_apart(spark, monkeypatch):
    rnd = random.Random(2)
    names = [None, "", "a", "B", "é", "z", *(f"s{i}" for i in range(60))]
    rows = [(i, "w " * rnd.randint(1, 9), s) for i, s in enumerate(names * 4)] + [(1000 + i, "w " * 50, "s7") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    said = lambda: Counter((r.doc_id, round(r.target, 6), r.copies) for r in mixing.mix(docs).collect())
    whole = said()
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 5)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert said() == whole


# ---- 2: quality ----


def _plain_train(rows, labels, order):
    """Follow-the-regularised-leader, a weight at a time."""
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for i in order:
        x = 1 / math.sqrt(len(rows[i])) if rows[i] else 0.0
        held = {k: weight(k) for k in rows[i]}
        p = 1 / (1 + math.exp(-(sum(held.values()) * x + bias)))
        g = (p - labels[i]) * x
        for k, w in held.items():
            before = n.get(k, 0.0)
            z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA * w
            n[k] = before + g * g
        gb = p - labels[i]
        zb += gb - (math.sqrt(nb + gb * gb) - math.sqrt(nb)) / quality.ALPHA * bias
        nb += gb * gb
        bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
    return {k: weight(k) for k in z}, bias


def test_quality_training_and_scores(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("good fine words here".split() if i % 2 else "BUY now !! !! free".split()) for _ in range(rnd.randint(0, 12))) for i in range(40)]
    labels = [i % 2 for i in range(40)]
    rows = quality.features(pa.array(texts))
    for text, found in zip(texts, rows, strict=True):  # distinct words and pairs, a pair of equal words being one feature
        hashes = Words(pa.array([text]), TOKENS, lower=False).hash.tolist()
        pairs = {(a, b) if a != b else "same" for a, b in zip(hashes, hashes[1:], strict=False)}
        assert len(found) <= len(set(hashes)) + len(pairs) and len(found) >= len(set(hashes))
    rng = np.random.default_rng(3)
    order = [i for _ in range(quality.EPOCHS) for i in rng.permutation(len(rows))]
    weights, bias = quality.train(rows, labels)
    plain, plain_bias = _plain_train([r.tolist() for r in rows], labels, order)
    assert bias == pytest.approx(plain_bias) and np.flatnonzero(weights).tolist() == sorted(k for k, w in plain.items() if w)
    assert all(weights[k] == pytest.approx(w, abs=1e-6) for k, w in plain.items())
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for r in quality.score(docs, (weights, bias)).collect():
        own = rows[r.doc_id].tolist() if r.doc_id < 40 else []
        assert r.score == pytest.approx(1 / (1 + math.exp(-(sum(plain.get(k, 0.0) for k in own) / max(1, math.sqrt(len(own))) + plain_bias))), abs=1e-6)


# ---- 4: sharding ----


def _draw(key, shard, weight=1.0):
    bits = _text(f"s/{shard}", _text(key)) >> 11
    return -math.log((bits + 0.5) / (1 << 53)) / weight


def test_sharding(spark):
    rows = [(i, "é" * (i % 7) + str(i)) for i in range(400)] + [(None, "x"), (None, None), (3, None), (3, "")]
    for shards in (1, 3, 16):
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()
        told = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got)
        want = Counter()
        for i, text in rows:
            key, raw = "null" if i is None else str(i), (text or "").encode()
            all_draws = [_draw(key, s) for s in range(shards + 1)]
            want[i, len(raw) + 1, zlib.crc32(raw), int(np.argmin(all_draws[:-1])), int(np.argmin(all_draws))] += 1
        assert told == want
        slots = Counter((r.shard, r.slot) for r in got)
        assert max(slots.values()) == 1 and all((s, n - 1) in slots for s, n in Counter(r.shard for r in got).items())
        assert all((r.region, r.rack) == (r.shard // 8, r.shard % 8 // 4) for r in got)


def test_growth_moves_rows_into_the_new_shard_at_every_number(spark):
    drawn = spark.range(3000).select(sharding.draws(F.col("id").cast("string"), sharding.tree_of(20)).alias("d"))
    rows = drawn.select(*[sharding.descend(F.filter("d", lambda x: x["shard"] < n))["shard"].alias(f"s{n}") for n in (1, 2, 3, 8, 9, 15, 16, 17, 18)]).collect()  # noqa: B023
    for n in (2, 3, 9, 16, 17, 18):
        moved = [r[f"s{n}"] for r in rows if r[f"s{n}"] != r[f"s{n - 1}"]]
        assert set(moved) == {n - 1} and abs(len(moved) - 3000 / n) < 5 * math.sqrt(3000 / n)


def test_a_row_descends_level_by_level_in_one_pass(spark):
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 0.5)]], [[(3, 1.0), (4, 2.0)], [(5, 1.0)]], [[(6, 1.0)]]]
    drawn = sharding.draws(F.col("id").cast("string"), tree)
    rows = spark.range(500).select(drawn.alias("d"), sharding.descend(drawn).alias("to")).collect()
    rows += spark.range(1).selectExpr("transform(array(6, 4, 3, 1), i -> named_struct('draw', 0.5D, 'region', i div 3, 'rack', i div 2, 'shard', i)) AS d").select("d", sharding.descend(F.col("d")).alias("to")).collect()  # ties
    for r in rows:
        below = r.d
        for level in ("region", "rack", "shard"):
            least = {getattr(x, level): min(y.draw for y in below if getattr(y, level) == getattr(x, level)) for x in below}
            below = [x for x in below if getattr(x, level) == min(least, key=lambda k: (least[k], k))]  # noqa: B023
        assert tuple(r.to) == tuple(below[0])
    assert str(sharding.descend(F.col("one_name"))).count("one_name") == 1  # each use of the draws computes all of them


def test_rows_repeated_very_often_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(5, "same")] * 900 + [(i, str(i)) for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4).collect()
    slots = Counter((r.shard, r.slot) for r in got)
    assert len(got) == 1200 and max(slots.values()) == 1 and all((s, n - 1) in slots for s, n in Counter(r.shard for r in got).items())


# ---- 7: licences ----


def test_matches_and_chains():
    rnd = random.Random(13)
    for _ in range(25):
        vocabulary = [f"w{i}" for i in range(4)]
        say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        templates = [(say(rnd.randint(4, 12)), f"t{k}") for k in range(3)]
        scanner = licences.Scanner((("w0 w1 w2", "p"),), templates)
        text = f"{say(25)} gap {say(12)}"
        ((n, places, chains),) = licences.scan_batch(scanner, pa.array([text]))
        w, k0 = text.split(), scanner.n_phrases
        assert n == len(w) and sorted(places) == [(i, 0) for i in range(len(w) - 2) if w[i : i + 3] == ["w0", "w1", "w2"]]
        runs = set()  # all runs of equal words that go on neither way
        for k, (said, _) in enumerate(templates):
            t = said.split()
            for i in range(len(w)):
                for j in range(len(t)):
                    if w[i] == t[j] and (i == 0 or j == 0 or w[i - 1] != t[j - 1]):
                        length = 0
                        while i + length < len(w) and j + length < len(t) and w[i + length] == t[j + length]:
                            length += 1
                        if length >= licences.MIN_MATCH:
                            runs.add((k + k0, i, i + length, j + length))
        ids, start, end = scanner.known_runs(Words(pa.array([text]), licences.ALNUM_WORDS))
        found = [m for lo, hi in zip(start.tolist(), end.tolist(), strict=True) for m in scanner.scan(ids[lo:hi].tolist(), lo)[1]]
        assert sorted(found) == sorted(runs)
        best = {}
        for k, *_ in runs:
            links = sorted(r[1:] for r in runs if r[0] == k)

            def longest(last, links=links):
                """Most words that a chain up to ``last`` covers."""
                most = last[1] - last[0]
                for one in links:
                    fresh = min(last[1] - last[0], last[1] - one[1], last[2] - one[2])
                    if fresh > 0 and last[0] - one[1] <= licences.MAX_GAP and last[2] - (last[1] - last[0]) - one[2] <= licences.MAX_GAP:
                        most = max(most, longest(one) + fresh)
                return most

            best[k] = max(map(longest, links))
        told = {}
        for k, s, e, covered in chains:
            told[k] = max(told.get(k, 0), covered)
            assert 0 <= s < e <= len(w)
        assert told == best
        for k in told:
            own = sorted((s, e) for x, s, e, _ in chains if x == k)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
        labels = {"p"} if places else set()
        labels |= {templates[k - k0][1] for k, c in best.items() if c >= licences.COVERAGE * len(templates[k - k0][0].split())}
        assert licences.digest(scanner, n, places, chains)[5] == ",".join(sorted(labels))


def test_whole_texts_and_their_spans(spark):
    whole = dict((label, text) for text, label in reversed(licences.TEMPLATES) if len(text) > 300)
    rows = [(i, f"head words {text} tail") for i, text in enumerate(whole.values())] + [(100, "nothing to see"), (101, None), (102, "See X.\n" + whole["zlib"].replace("commercial", "COMMERCIAL"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {r.doc_id: r.labels.split(",") for r in licences.scan(docs).collect()}
    assert all(label in labels[i] for i, label in enumerate(whole)) and labels[100] == labels[101] == [""] and labels[102] == ["zlib"]
    spans = [r for r in licences.spans(docs).collect() if r.coverage == 1.0]
    for i, (label, text) in enumerate(whole.items()):
        n = len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
        assert any((r.doc_id, r.label, r.start_word, r.end_word, r.template_words) == (i, label, 2, 2 + n, n) for r in spans)


# ---- 8: language ----


def test_network_against_its_definition():
    rng = np.random.default_rng(1)
    texts = ["the cat sat " * 40, "é" * 300, "ab", "x1 y2 Z3!" * 70]
    windows = [langid.windows_of(t.encode()) for t in texts]
    for text, w in zip(texts, windows, strict=True):
        raw = text.encode()
        assert w.shape == (-(-len(raw) // langid.WINDOW), langid.WINDOW) and w.reshape(-1)[: len(raw)].tolist() == [langid._CLASS[b] for b in raw] and not w.reshape(-1)[len(raw) :].any()
    net = langid.train(np.concatenate(windows), rng.integers(0, 2, sum(map(len, windows))), ["a", "b"])
    for text, w in zip(texts, windows, strict=True):
        scores = np.zeros(2)
        for window in w:
            pooled = []
            for kernel, bias in zip(net.filters, net.bias, strict=True):
                for f in range(langid.FILTERS):
                    pooled.append(max(sum(float(kernel[j][window[p + j]][f]) for j in range(len(kernel))) for p in range(langid.WINDOW - len(kernel) + 1)) + float(bias[f]))
            z = np.maximum(pooled, 0) @ net.dense + net.dense_bias
            scores += np.exp(z) / np.exp(z).sum() * (window > 0).sum()
        ((lang,), (score,)) = langid.predict_batch(net, [text])
        assert lang == net.labels[int(scores.argmax())] and score == pytest.approx(scores.max() / scores.sum(), abs=1e-4)


def test_training_reads_whole_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda windows, targets, labels, seed=5: seen.update(windows=windows, targets=targets, labels=labels))
    rows = [(1, "a" * 5000, "xx"), (2, "b c", "yy"), (3, None, "xx"), (4, "!!", "yy"), (5, "no label", None)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen["windows"]) == 21 and Counter(seen["targets"].tolist()) == {0: 20, 1: 1} and seen["labels"] == ["xx", "yy"]
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 2000)
    langid.fit(spark.createDataFrame([(i, "word " * 20, "xx") for i in range(400)], "doc_id long, text string, lang string"))
    assert 5 <= len(seen["windows"]) <= 45  # about 2000 bytes of 40 000, in whole texts


# ---- 10: personal data ----


def test_graph_scores(spark):
    rnd = random.Random(21)
    items = [(rnd.randrange(2), rnd.randrange(20), rnd.randrange(80), rnd.random() < 0.35) for _ in range(160)]
    edges = {}
    for form, context, value, seed in items:
        edges[form, context, value] = edges.get((form, context, value), False) or seed
    score = {}
    for (form, _, value), seed in edges.items():
        score[form, value] = max(score.get((form, value), 0.0), float(seed))
    first, trusted, before = dict(score), {}, -1
    while True:
        by = {}
        for form, context, value in edges:
            by.setdefault((form, context), []).append(score[form, value])
        trusted = {c: sum(s) / len(s) for c, s in by.items() if len(s) >= pii.SUPPORT and sum(s) / len(s) >= pii.CONFIDENCE}
        if len(trusted) <= before:
            break
        before = len(trusted)
        score = {k: max([first[k], *(trusted[k[0], c] for f, c, v in edges if (f, v) == k and (f, c) in trusted)]) for k in score}
    got = pii._trusted(spark.createDataFrame(items, "form int, context long, value long, seed boolean"), pii.Scratch(spark, "test")).collect()
    assert {(r.form, r.context) for r in got} == set(trusted) and 0 < len(trusted) < len(by)


def test_a_round_of_the_graph_writes_one_table(spark, monkeypatch):
    written, write = [], pii.Scratch.write
    monkeypatch.setattr(pii.Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    rows = [(i, f"token = 'ab12ab12ab12ab12ab12ab{i:02}' and mail a{i}@b.org now") for i in range(6)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.spans.startswith("id:9:33,email:") for r in got)
    assert written[:3] == ["spans", "items", "graph"] and written[3:] == [f"trusted{k}" for k in range(len(written) - 3)] and len(written) > 3


def test_keys_are_found_where_something_is_assigned(spark):
    rnd = random.Random(3)
    key = lambda n: "a1" + "".join(rnd.choice("0123456789abcdef") for _ in range(n - 2))
    rows = [(i, f'then token = "{key(40)}" and on') for i in range(5)]
    rows += [(10, 'then token = "zz99zz99" and on'), (11, f"a commit {key(40)} here"), (12, 'say "zz99zz99zz" so'), (13, f'other = "{key(40)}" once'), (14, "token = none")]
    rows += [(20, f'{"long word " * 5000}then token = "b2{"7" * 30}" end')]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "id:14:54" for i in range(5)) and got[10] == "id:14:22" and got[11] == got[12] == got[14] == "" and got[20] == "id:50014:50046"
