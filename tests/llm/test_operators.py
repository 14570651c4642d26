"""The operators against brute force, exact round trips and edge cases, on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, jpeg, langid, licences, media, mixing, pii, quality, sharding, simjoin, textkernel
from tidemark.llm.textkernel import SPACE_WORDS, Words, chunks, shingle_sets

DOCS = "doc_id long, text string, source string, size string"
LONG = "word " * 30_000
EDGES = [(1, None, "a", "x"), (2, "", None, "x"), (3, "one", "b", None), (3, "one", "b", None), (4, LONG, "b", "x"), (5, "é ü ñ", "a", "x"), (6, "one", "a", "x"), (None, "lone words", None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


def words(text, pattern=r"[^\x20\x09-\x0d]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# ---- kernel ----


def test_word_kernel():
    texts = ["The cat\ton é the", None, "", "  the ", "the cat"]
    got = Words(pa.array(texts), SPACE_WORDS)
    assert got.counts().tolist() == [5, 0, 0, 1, 2]
    assert got.hash[0] == got.hash[4] == got.hash[5] and len(set(got.hash.tolist())) == 4
    assert [len(s) for s in shingle_sets(got, 3)] == [3, 0, 0, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "b" * 100, None, "c"])], ["text"])
    assert [part.num_rows for part in chunks(batch, "text", 20)] == [1, 1, 2] or sum(p.num_rows for p in chunks(batch, "text", 20)) == 4


def test_words_are_hashed_in_pieces_of_bounded_memory(monkeypatch):
    text = "word and öther " * 60_000 + "x" * 400_000 + " end"
    got = Words(pa.array([text, "end"]), SPACE_WORDS)
    assert len(textkernel._POWERS) <= 400_002 and got.hash[-1] == got.hash[-2] and got.hash[0] == got.hash[-6] != got.hash[1]
    monkeypatch.setattr(textkernel, "HASH_BYTES", 64 << 20)  # all at once
    assert Words(pa.array([text, "end"]), SPACE_WORDS).hash.tolist() == got.hash.tolist()


# ---- 1: mixing ----


def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.water_fill([0, 10], [1, 1], 1.5, 2.0) == pytest.approx([0, 15])
    assert mixing.water_fill([], [], 1.5, 2.0) == []


def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(1, 40), rnd.choice(["s1"] * 6 + ["s2", "s3", None]), None) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == 3000 and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    source = {i: s for i, _, s, _ in rows}
    taken, target, most = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s], target[s], most[s] = taken.get(s, 0) + r.taken, r.target, max(most.get(s, 0), r.size)
    for s in taken:
        assert abs(taken[s] - target[s]) <= most[s]


def test_mix_edges(spark, edges):
    got = {r.doc_id: r for r in mixing.mix(edges).collect()}
    assert got[1].size == 0 and got[1].taken == 0 and got[4].size == 30_000
    assert mixing.mix(edges.limit(0)).count() == 0
    mixed = mixing.mixed_documents(edges)
    assert mixed.columns == edges.columns and mixed.filter("doc_id = 1 and size <> 'x'").count() == 0


# ---- 2: quality ----


def test_quality_learns_and_scores(spark, edges):
    rnd = random.Random(1)
    good = [" ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(rnd.choice("BUY!! NOW!! ###".split()) for _ in range(30)) for _ in range(60)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)]
    model = quality.fit(spark.createDataFrame([r for r in rows if r[0] % 2], "doc_id long, text string, label int"))
    held = spark.createDataFrame([r[:2] for r in rows if r[0] % 2 == 0], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality.score(held, model).collect()}
    assert np.mean([(s >= 0.5) == (i < 60) for i, s in scores.items()]) > 0.95
    assert quality.score(edges, model).count() == len(EDGES)
    empty = quality.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r.score for r in quality.score(edges, empty).collect()} == {0.5}
    assert quality.score(edges.limit(0), model).count() == 0


# ---- 3: media ----


def _slow_inverse(block):
    """One block's samples, from the definition."""
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    grid = np.zeros(64)
    grid[jpeg.zigzag()] = block
    grid = grid.reshape(8, 8)
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = 0.25 * sum(c(u) * c(v) * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    return out


def test_jpeg_round_trip_is_exact():
    rng = np.random.default_rng(0)
    payloads = [media.payload_of(t)[0] for t in (None, "", "x" * 64, "x" * 65, "été " * 500)]
    payloads += [rng.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 5, 6, 7, 40)] + [bytes(64 * 9)]
    files = media.encode(payloads)
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)
    back = media.decode(files)
    assert [p for p, _ in back] == payloads
    assert all(t.dtype == np.uint8 and t.shape[0] % 16 == 0 for _, t in back)
    assert media.encode(payloads[3:6]) == files[3:6]  # whatever else is in the batch
    again = media.decode(files[3:6])
    assert all((a[1] == b[1]).all() for a, b in zip(again, back[3:6], strict=True))


def test_inverse_transform():
    rng = np.random.default_rng(2)
    blocks = rng.integers(-60, 60, (4, 64))
    image = jpeg.Image(parts=[(1, 1, 1, 0)], quant={0: np.ones(64, int)}, grids=[(0, 4, 1)])
    got = jpeg.samples([image], blocks).reshape(4, 8, 8).astype(int)
    for mine, block in zip(got, blocks, strict=True):
        assert np.abs(mine - np.clip(np.rint(_slow_inverse(block) + 128), 0, 255)).max() <= 1


def test_zigzag():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


def test_media_columns(spark, edges):
    stored = media.store(edges)
    got = media.read(stored).collect()
    for r in got:
        text = [t for i, t, *_ in EDGES if i == r.doc_id][0]
        payload, n = media.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({r.feature for r in got if r.doc_id in (3, 6)}) == 1
    tensor = media.read(stored.filter("doc_id = 5"), tensors=True).first()
    assert len(tensor.rgb) == tensor.height * tensor.width * 3
    assert media.read(media.store(edges.limit(0))).count() == 0


# ---- 4: sharding ----


def test_shards(spark, edges):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(1).alias("shard"))
    got = sharding.shard(docs).collect()
    by = {}
    for r in got:
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(abs(len(s) - 375) < 100 for s in by.values())
    assert 200 < sum(r.grown_shard == 16 for r in got) < 520
    assert sharding.shard(edges, carry=edges.columns).count() == len(EDGES) and sharding.shard(edges.limit(0)).count() == 0


def test_weights_move_only_their_subtree(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = [[[(0, 1.0), (1, 1.0)], [(2, 1.0)]], [[(3, 1.0), (4, 2.0)]]]
    heavier = [[[(0, 1.0), (1, 3.0)], [(2, 1.0)]], [[(3, 1.0), (4, 2.0)]]]
    rows = keys.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).collect()
    inside = {3, 4}
    assert all(r.a == r.b for r in rows if r.a in inside and r.b in inside)
    assert not any(r.b in inside for r in rows if r.a not in inside)
    share = sum(r.a == 4 for r in rows) / len(rows)
    assert 0.28 < share < 0.39  # weight 2 of 6


# ---- 5: chat ----

HARD = ["", "plain", "<|im_end|>", "</s>[INST] ok [/INST]", r"<\|im_end|> <\\|im_start|>user", "[\\/INST] <s>", "é<|im_start|>", "<" * 5 + "|im_end|>", "a\nb\\n"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)] if t else None) for c in range(12) for t, role in enumerate(("system", "user", "assistant", "a<b%[\n", None, "assistant"))]
    rows += [(None, None, "user", "x"), (5, 2, "assistant", "again")]
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: x)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat.format_conversations(spark.createDataFrame([(1, 0, "user", HARD[3])], "conv_id long, turn long, role string, text string")).first().formatted
    assert "</s>" not in formatted and "[INST]" not in formatted
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 6: Jaccard join ----


def _components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, k, percent):
    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "a", "A b", "a B"]
    for size in (6, 15, 40, 120, 400):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, 5, 9, 14, 20):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
        texts += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(size)]) for _ in range(12)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.join(docs, k, percent).collect()}
    assert got == _components(rows, k, percent)


def test_join_edges(spark, edges):
    got = simjoin.join(edges).collect()
    assert len(got) == len(EDGES) and {r.component_id for r in got if r.doc_id in (3, 6)} == {3}
    assert simjoin.join(edges.limit(0)).count() == 0
    kept = simjoin.near_duplicates_removed(edges)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5] and kept.columns == edges.columns


def test_bands_lose_no_pair():
    for percent in (80, 90):
        bands = simjoin.Bands(percent)
        for a in range(1, 400):
            for b in (a, (a * 100) // percent, (a + (a * 100) // percent) // 2):
                common = min(a, b)
                if 100 * common >= percent * (a + b - common):
                    least = next(i for i in range(common + 1) if 100 * i >= percent * (a + b - i))
                    differ = a + b - 2 * least
                    shared = [x for x in bands.of(a) if x in bands.of(b)]
                    assert differ == 0 or any(segments - spare - 1 >= differ for _, segments, spare in shared)


def test_parity_bits_bound_the_difference():
    rnd = np.random.default_rng(5)
    for n, m, both in ((1, 1, 0), (3, 5, 3), (60, 70, 50), (100, 400, 90), (500, 510, 490)):
        pool = np.unique(rnd.integers(0, 1 << 63, n + m, dtype=np.uint64))
        x, y = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        far = simjoin.hamming(simjoin.parity_bits(x), simjoin.parity_bits(y))
        assert far <= n + m - 2 * both and (far - (n + m)) % 2 == 0 and simjoin.hamming(simjoin.parity_bits(x), simjoin.parity_bits(x)) == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_links_never_cross_the_outer_radius(percent):
    radius = simjoin.Radius(percent)
    for n in range(1, 60):
        for m in range(-(-n * percent // 100), n * 100 // percent + 1):
            apart = (100 - percent) * (n + m) // (100 + percent)
            assert apart <= min(radius.most(n), radius.most(m)) and radius.linked(n + m, apart) and not radius.linked(n + m, apart + 1)
            assert radius.inner(n) + apart <= radius.outer(m)


@pytest.mark.parametrize("lead", ["near", "empty"])
def test_members_of_a_leader_against_brute_force(spark, tmp_path, lead):
    rnd, percent = random.Random(lead), 80
    base, sets = set(range(1000, 1024)), []
    for _ in range(150):
        gone, new = rnd.sample(sorted(base), rnd.randint(0, 5)), [rnd.randrange(12) for _ in range(rnd.randint(0, 5))]
        sets.append(frozenset(base - set(gone) | set(new)))
    sets = sorted(set(sets) - {frozenset(base)}, key=sorted)
    rows = [(i, 0, len(s), len(s ^ base), sorted(s ^ base)) if lead == "near" else (i, 0, len(s), len(s), sorted(s)) for i, s in enumerate(sets)]
    known = spark.createDataFrame(rows, "a long, lead long, n long, d long, parts array<long>")
    scratch = simjoin.Scratch(spark, "test")
    links = simjoin._within(known, spark.createDataFrame([], "node long, root long"), percent, scratch, lead).collect()
    assert all(100 * len(sets[r.a] & sets[r.b]) >= percent * len(sets[r.a] | sets[r.b]) for r in links)
    near = [[100 * len(x & y) >= percent * len(x | y) for y in sets] for x in sets]
    found = [[i == j for j in range(len(sets))] for i in range(len(sets))]
    for r in links:
        found[r.a][r.b] = found[r.b][r.a] = True
    assert _reach(found) == _reach(near) and len(set(_reach(near))) > 1


def test_copies_of_one_text_are_no_candidates_of_each_other(spark):
    # what the leader has of its own is in the difference of every member
    known = [(i, 0, 100, 12, [1, 2, 3, 4, 5, 6, *range(100 + 6 * i, 106 + 6 * i)]) for i in range(60)]
    known += [(60 + i, 0, 100, 20, [*range(10, 24), *range(1000 + 6 * i, 1006 + 6 * i)]) for i in range(2)]  # 12 apart, 26 from all others
    scratch = simjoin.Scratch(spark, "test")
    links = simjoin._within(spark.createDataFrame(known, "a long, lead long, n long, d long, parts array<long>"), spark.createDataFrame([], "node long, root long"), 80, scratch, "x")
    found = [[i == j for j in range(62)] for i in range(62)]
    for r in links.collect():
        found[r.a][r.b] = found[r.b][r.a] = True
    assert _reach(found) == [0] * 60 + [60] * 2
    assert spark.read.parquet(f"{scratch.root}/metx").count() == 1  # 1 771 seen from the leader


def _reach(linked):
    """The least member that each one reaches."""
    root = [None] * len(linked)
    for i in range(len(linked)):
        todo = [i] if root[i] is None else []
        while todo:
            j = todo.pop()
            if root[j] is None:
                root[j] = i
                todo += [k for k, link in enumerate(linked[j]) if link]
    return root


def test_members_of_a_key_choose_leaders_until_all_are_known(spark, monkeypatch):
    # unlike texts with one passage in common, and copies of some: keys of the passage have many far members
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(30):
        own = passage + [f"t{k}_{i}" for i in range(45)]
        texts += [own, [*own, "z"], [*own[:-6], *"abcdef"]][: 1 + k % 3]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = _components(rows, 3, 90)
    monkeypatch.setattr(simjoin, "ROUNDS", 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.join(docs).collect()} == want


def test_each_text_of_a_repeated_id_is_a_row_of_its_own(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    c, d, e = (" ".join(f"{k}{i}" for i in range(30)) for k in "cde")
    rows = [(3, a), (7, a), (7, b), (7, b), (None, c), (None, c), (5, c + " x"), (None, d), (None, d + " x"), (None, e), (8, ""), (8, None)]
    kept = [(r.doc_id or 0, r.text) for r in simjoin.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) in (sorted([(3, a), (7, b), (5, c + " x"), (0, t), (0, e), (8, ""), (8, None)], key=str) for t in (d, d + " x"))


def test_short_variants_of_one_text(spark):
    rnd, base = random.Random(12), [f"w{i}" for i in range(20)]
    rows = []
    for i in range(3000):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(20)] = f"v{rnd.randrange(6)}"
        rows.append((i, " ".join(w[: rnd.choice([18, 19, 20])])))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in rows]
    at = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(at)), np.float32)
    for i, s in enumerate(sets):
        has[i, [at[g] for g in s]] = 1
    both, size = has @ has.T, has.sum(1)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in np.argwhere(100 * both >= 90 * (size[:, None] + size[None, :] - both)).tolist():
        if i < j:
            i, j = sorted((find(i), find(j)))
            root[j] = i
    got = {r.doc_id: r.component_id for r in simjoin.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


@pytest.mark.parametrize("where", ["bridge", "pivot"])
def test_null_ids_link_others(spark, where):
    base = [f"w{i}" for i in range(40)]
    if where == "bridge":  # ends that link only by way of the text in the middle, whose rows have no id
        one, other = [*base[:-2], "x", "y"], ["u", "v", *base[2:]]
        rows = [(1, " ".join(one)), (2, " ".join(other)), (None, " ".join(base)), (None, " ".join(base)), (None, " ".join(base))]
        linked = [{1, 2}]
    else:  # pairs around texts without id, each of which may be the pivot of the group of all
        rows, linked = [], []
        for k in range(12):
            w = [*base[: 20 - k], *[f"k{k}_{j}" for j in range(20)], *base[20 - k :]]
            rows += [(None, " ".join([*w, f"n{k}"])), (2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, f"z{k}"]))]
            linked.append({2 * k, 2 * k + 1})
        rows += [(None, " ".join(base[:j] + ["q", str(j)] + base[j:])) for j in range(0, 40, 4)]
    got = simjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        if r.doc_id is not None:
            groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, linked))


# ---- 7: licences ----


def test_licence_scan(spark, edges):
    rnd = random.Random(3)
    parts = ["under the MIT license", "Apache License, Version 2", "CC BY-NC", "cc", "by", "under the", "license", "mit", "foo", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = words(text, ALNUM)
        places = [(j, label) for phrase, label in licences.PHRASES for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == (min((j for j, _ in places), default=None), max((j for j, _ in places), default=None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert ("GNU" not in text) or "gpl-3" in r.labels
    assert licences.scan(edges).count() == len(EDGES) and licences.scan(edges.limit(0)).count() == 0


def test_matching_statistics():
    seqs = [[0, 1, 2, 3, 1, 2], [1, 2, 4], [2, 3, 1, 1]]
    auto = licences.Automaton(seqs)
    rnd = random.Random(5)
    text = [rnd.randrange(5) for _ in range(300)]
    there = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i, (_, length) in enumerate(auto.stream(text)):
        assert length == max((n for n in range(1, 7) if n <= i + 1 and tuple(text[i + 1 - n : i + 1]) in there), default=0)


# ---- 8: language ----


def test_language_id(spark, edges):
    rnd = random.Random(7)
    said = {"xx": "the and that with this", "yy": "und der nicht auch sie", "zz": "el que los para por"}
    rows = [(i, " ".join(rnd.choice(said[lang].split()) for _ in range(40)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 80)]
    net = langid.fit(spark.createDataFrame(rows[:180], "doc_id long, text string, lang string"))
    held = spark.createDataFrame(rows[180:] + [(900, None, None), (901, "123 !!", None), (902, "é", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(held, net, carry=["doc_id"]).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[180:]]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in said and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(edges, None, carry=edges.columns).filter("lang_pred <> 'und'").count() == 0
    windows = langid.windows_of(b"the cat" * 100)
    assert windows.shape == (3, 256)
    assert np.allclose(net.probabilities(windows), _plain(net, windows), atol=1e-4)


def _plain(net, windows):
    z = np.maximum(net.pooled(windows)[0], 0) @ net.dense + net.dense_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


# ---- 9: decontamination ----


def _overlap(text, items):
    w = words(text, ALNUM)
    hit, found = set(), set()
    for item, said in items:
        x = words(said, ALNUM)
        size = min(10, len(x))
        for s in range(max(0, len(x) - size + 1)) if x else ():
            for p in range(len(w) - size + 1):
                if w[p : p + size] == x[s : s + size]:
                    hit |= set(range(p, p + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, edges):
    rnd = random.Random(9)
    vocabulary = ["Alpha", "béta", "gamma", "delta", "the", "of", "É", "x1"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, say(12)), (10, "the of"), (11, None), (12, ""), (3, say(10)), (3, "Gamma gamma"), (None, "delta delta delta")]
    texts = [None, "", "the of the of", say(60), items[0][1] + " tail", "head " + " ".join(items[1][1].split()[:9]), items[2][1].upper(), say(5) + " " + items[0][1] + " " + say(5), "delta delta delta"]
    rows = list(enumerate(texts)) + [(0, None), (4, texts[4])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.report(docs, benchmark).collect()
    expected = {i: _overlap(t, items) for i, t in rows}
    assert len(got) == len(rows) and all(tuple(r)[1:] == expected[r.doc_id] for r in got)
    assert sorted(r.doc_id for r in decontam.clean_documents(docs, benchmark).collect()) == sorted(i for i, _ in rows if not expected[i][4])
    assert decontam.report(edges, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(edges.limit(0), benchmark).count() == 0


# ---- 10: personal data ----

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    out = []
    for k, (_, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(digits) <= 19 and _luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, edges):
    rnd = random.Random(11)
    parts = ["a@b.c", "_d@e.f", "x@y", "1.2.3.4", ".5.6", "300.1.1.1", "01.02.003.255", "+1 (487) 555-7209", "4111 1111 1111 1111", "4111-1111-1111-1112", "++12 345 678 90", "é", " ", "9", "."]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))) for i in range(200)] + [(500, None), (501, "1" * 20_000 + "a." * 9000 + "@b" + ".c" * 3000)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i == 501:
            continue  # the plain patterns take quadratic time there
        spans = _base(text)
        told = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in spans)
        assert [got[i][f"n_{name}"] for name, _ in PLAIN] == [sum(k == x for _, x, _ in spans) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[501].n_email == 1
    assert pii.find(edges).count() == len(EDGES) and pii.find(edges.limit(0)).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"pay to card no. 411111111111{x} now") for i, x in enumerate(("1111", "1129", "1137", "1145"))]
    rows += [(10, "also card no. AB12345678 and"), (11, "see room XY12345678"), (12, 'key="zz99zz99zz"')]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == "id:14:24" and got[11] == "" and got[12] == "" and got[0] == "card:16:32"


def test_every_kind_discovers_its_shapes(spark):
    rows = [(i, f"please mail {n}@b{n}.org soon") for i, n in enumerate("abcdef")] + [(10, "please mail jo at home.org soon"), (11, "please mail jo@localhost soon"), (12, "please mail jo (at) home (dot) org")]
    rows += [(20 + i, f"from host 10.0.0.{i} today") for i in range(4)] + [(30, "from host 10.0.0.256 today"), (31, "from host 10.0.7 today")]
    rows += [(40 + i, f"just call +1 (487) 555-720{i} now") for i in range(4)] + [(50, "just call (487) 555-7209 now"), (51, "just call 487-555-7209 now")]
    rows += [(60, "look at home.org or (487) 555-7209 or 10.0.0.256"), (61, "host jo@localhost")]
    # a context shared evenly by cards and phones is one of neither
    rows += [(70 + i, f"seen in 411111111111{x} there") for i, x in enumerate(("1111", "1129", "1137"))] + [(80 + i, f"seen in +1 487 555 800{i} there") for i in range(3)] + [(90, "seen in 4111111111111112 there")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in (10, 11, 12)} == {10: "id:12:26", 11: "id:12:24", 12: "id:12:34"}
    assert {i: got[i] for i in (30, 31, 50, 51)} == {30: "id:10:20", 31: "id:10:16", 50: "id:10:24", 51: "id:10:22"}
    assert {i: got[i] for i in (60, 61, 90)} == {60: "", 61: "", 90: ""}
