"""Conversation repair, prefix trie and SimHash near-duplicates."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import graph, repair, simhash, trie

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("gone", "again", "place", "turns", "key", "text_a")],
])
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("fp", "root", "node", "mask", "component_id")],
])


def turns_of(spark, rows):
    """Rows with more columns, named as the operators' own."""
    return spark.createDataFrame([(*r, "true", "x", "y", "z", "k", "t") for r in rows], TURNS)


def some_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        role = rng.choice(["system", "user", "user", "user", "assistant"])
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " ", "Étude. ", "a\nb.", "x" * rng.randint(1, 30) + "."])
            rows.append((c, t if rng.random() < 0.95 else t + 1, role, text))
            role = rng.choice(["user", "assistant", "assistant" if role == "user" else "user", "tool"])
    gone = next(c for c in range(3000, 4000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [
        (gone, 0, "user", "Dropped."), (None, None, None, None), (None, 3, "user", "Hi."), (1000, None, "user", None), (1000, None, None, "A."),
        (1001, 5, "assistant", "late."), (1001, 5, "assistant", "late."), (1001, 5, "user", ""), (1002, 0, "", ""),
        (1003, 0, "user", "y. " * 40_000), (1003, 1, "assistant", "z" * 100_000),
    ]


# --- repair -----------------------------------------------------------------------

def cheapest(rows):
    """(cost, audit) by a dynamic programme over all states."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(ways):
        for _ in range(3):
            for q, (cost, audit) in list(ways.items()):
                ways[after[q]] = min(ways.get(after[q], (10**9, "")), (cost + 3, audit + "I"))
        return ways

    ways = inserted({0: (0, "")})
    for initial, fault in rows:
        new = {}
        for q, (cost, audit) in ways.items():
            late = 3 * (fault == repair.CUT)
            options = [(q, (cost + 4, audit + "D"))]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                options.append((after[q], (cost + late + 3, audit + "R")))
                if (q, initial) in keeps:
                    options.append((keeps[q, initial], (cost + late, audit + "K")))
            for to, way in options:
                new[to] = min(new.get(to, (10**9, "")), way)
        ways = inserted(new)
    return min(ways[q] for q in (0, 3) if q in ways)


def test_search_finds_the_cheapest_edits():
    rng = random.Random(4)
    for _ in range(1500):
        rows = [(rng.choice("uuaasx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 13))]
        assert repair.repaired(rows) == cheapest(rows), rows


def test_suffix_bounds_never_exceed_the_rest():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("uas"), rng.choice([0, 0, 1, 3])) for _ in range(8)]
        faults, pairs, _ = repair.bounds(rows)
        least = min(cost for start in range(4) for cost, _ in repair.search(rows, start, {2, 3}).values())
        assert faults[0] + -(-pairs[0] // 2) <= least


@pytest.mark.parametrize("block", [1, 4, 16])
def test_blocks_chain_to_the_same_edits(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for n in [*rng.choices(range(40), k=150), 1500]:
        conv, faults, pending = repair.Conversation(7), [], 0
        texts = {"": repair.BLANK, "cut": repair.CUT, "Whole.": 0}
        for turn in range(n):
            role, text = rng.choice(["user", "assistant", "system"]), rng.choice(["", "cut", *["Whole."] * 4])
            again = bool(text) and rng.random() < 0.05
            faults.append((role[0], repair.DUPLICATE if again else texts[text]))
            assert not list(conv.add(turn, role, text, again)) or n > block
            pending = max(pending, *(len(pieces) for _, pieces in conv.ways.values()))
        list(conv.close())
        assert conv.summary()[6:8] == cheapest(faults)
        assert pending * block <= 100 or n < 1500  # a long conversation is not held


def plain_repair(rows):
    """conv_id -> the contract's columns, from rows as given."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        kind, here = zlib.crc32(key.encode()) % 20, after[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            here += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, some in after.items():
        some.sort()
        seen, faults = set(), []
        for _, _, role, text in some:
            kept = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append(1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[:1] for _, _, r, _ in some]
        turns = {t for known, t, _, _ in some if known}
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        lines, i, state = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = 3 if state == 2 else 2
                lines.append(("assistant:", "user:")[state == 2])
                continue
            _, _, role, text = some[i]
            i += 1
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif edit == "R":
                state = 3 if state == 2 else 2
                role = ("assistant", "user")[state == 2]
            if edit != "D":
                lines.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines,
        )
    return out


def test_repair_equals_plain_repair(spark):
    rows = some_turns(1, 150)
    damaged = repair.damaged(turns_of(spark, rows))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(damaged).collect()}
    want = plain_repair(rows)
    assert got == {c: w[:8] for c, w in want.items()}
    assert any(not w[6] for w in got.values()) and len(got) == len({c for c, *_ in rows})
    lines = defaultdict(list)
    for r in repair.repaired_turns(damaged).orderBy("place").collect():
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: w[8] for c, w in want.items() if w[8]}


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(turns_of(spark, []))).collect() == []
    assert repair.repaired_turns(turns_of(spark, []).drop("gone")).collect() == []


# --- trie -------------------------------------------------------------------------

def plain_trie(conversations):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))

    def below(prefix):
        leaves, saved = 0, (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        for child in children.get(prefix, ()):
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves or 1, saved

    out = []
    for prefix, here in members.items():
        ends = ",".join(map(str, sorted(c for c in here if len(conversations[c]) == len(prefix))))
        out.append((min(here), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(here),
                    len(children.get(prefix, ())), *below(prefix), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(conversations, block):
    """The trie by blocks of so many conversations, merged."""
    rows = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), c, [len(t[1].encode()) for t in turns])
                  for c, turns in conversations.items())
    found = []
    for at in range(0, len(rows), block):
        some = defaultdict(list)
        for key, c, sizes in rows[at:at + block]:
            some[key, tuple(sizes)].append(c)
        found += trie.contract(at, [k for k, _ in some], [list(z) for _, z in some], list(some.values()))
    merged = list(trie.merge([r for r in found if "first_key" in r]))
    paths = {r["block"]: r for r in merged if "block" in r}
    ends = defaultdict(list)
    for r in found:
        if "ids" in r:
            ends[paths[r["block"]][("first_nodes", "last_nodes")[r["side"]]][r["depth"]]].append((r["block"], r["piece"], r["ids"]))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = []
    for r in merged:
        if "node" in r:
            joined = ",".join(ids for *_, ids in sorted(ends[r["node"]]))
            out.append(r | {"ends_sha256": hashlib.sha256(joined.encode()).hexdigest()})
    for r in found:
        if "conv_id" in r:
            if "side" in r:
                r["parent_conv_id"] = paths[r["block"]][("first_convs", "last_convs")[r["side"]]][r["parent_depth"]]
            out.append(r)
    return sorted((tuple(r[c] for c in columns) for r in out), key=str)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_forests_merge_to_the_trie(monkeypatch, block):
    monkeypatch.setattr(trie, "PIECE_IDS", 2)
    for seed in range(60):
        rng = random.Random(seed)
        conversations = {
            c: [(rng.choice("ab"), rng.choice(["x", "yé", ""])) for _ in range(rng.randint(0, 5))]
            for c in rng.sample(range(-5, 200), rng.randint(1, 40))
        }
        assert nodes_of(conversations, block) == plain_trie(conversations)


def test_trie_of_a_table(spark):
    rng = random.Random(3)
    rows = some_turns(2, 60) + [(c, t, "user", "Common.") for c in range(2000, 2200) for t in range(rng.randint(1, 3))]
    whole = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            whole[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in whole.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    got = trie.prefix_trie(trie.rebuilt(trie.conversation_keys(turns_of(spark, rows))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rebuilt)
    assert any(not turns for turns in rebuilt.values())


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(trie.rebuilt(trie.conversation_keys(turns_of(spark, [])))).collect() == []


# --- SimHash ----------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes):
    """Distinct codes to the smallest one of their component."""
    codes = sorted(set(codes))
    root = {c: c for c in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def near(rng, code, bits):
    for b in rng.sample(range(64), bits):
        code ^= 1 << b
    return code


def some_codes(seed, n):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3):
        codes += [near(rng, c, rng.randint(1, 4)) for c in rng.sample(codes, n // 2)]
    return [0, 1, 7, 15, (1 << 64) - 1, *codes]


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    texts = ["", " \n", "One", "one TWO", "a\x0bb\x1cc d", "É é\x85x y z w", "　x y\xa0z q"] + [
        " ".join(rng.choice(["Stream", "dry", "BED", "é"]) + rng.choice(["", "\n", "  "]) for _ in range(rng.randint(1, 60)))
        for _ in range(60)]
    for portion in (7, 1 << 20):
        monkeypatch.setattr(simhash, "TEXT_AT_ONCE", portion)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), repr(t)


def test_gray_rank():
    ranks = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


@pytest.mark.parametrize("pairs", [8, 1 << 20])
def test_index_under_one_node(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", pairs)
    codes = some_codes(1, 120)
    a, b = simhash.Index(np.zeros(len(codes), np.int64), np.array(codes, np.uint64)).links()
    root = plain_components(codes)
    label = {c: c for c in codes} | dict(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True))
    same = defaultdict(set)
    for c in codes:
        same[label[c]].add(root[c])
    assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(root.values()))


def test_blocks_of_bits_leave_no_pair_out():
    rng = random.Random(6)
    for mask in (0, 0xFFFF, 0xFFFF0FFF, (1 << 45) - 1):
        inner = simhash.blocks(mask)
        for _ in range(200):
            free = [b for b in range(64) if not mask >> b & 1]
            x = sum(1 << b for b in rng.sample(free, 3))
            assert any(not x & m for m in inner)


@pytest.mark.parametrize("held", [64, 1 << 12])
def test_links_of_all_codes(spark, monkeypatch, held):
    """Also with nodes that are factored again and again."""
    monkeypatch.setattr(simhash, "NODE_ROWS", held)
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    codes = sorted({*some_codes(8, 60), *(near(rng, centre, rng.randint(1, 6)) for _ in range(150))})
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    found = graph.components(simhash.links(frame)).collect()
    got = {c: c for c in codes} | {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    want = plain_components(codes)
    groups = lambda of: sorted(sorted(c for c in codes if of[c] == r) for r in set(of.values()))
    assert groups(got) == groups(want)


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)) for _ in range(25)]
    texts = base + [t.replace("a", "A") for t in base[:10]] + [t + " End of it" for t in base[5:15]] + [None, "", " ", "One", "one", None]
    rows = list(enumerate(texts, 100)) + [(100, texts[0]), (None, texts[3]), (None, "alone here"), (7, "x " * 300_000)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS)
    codes = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(codes)
    least = defaultdict(list)
    for (i, _), c in zip(rows, codes, strict=True):
        if i is not None:
            least[root[c]].append(i)
    want = [(i, f"{c:016x}", min(least[root[c]], default=None)) for (i, _), c in zip(rows, codes, strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


# --- joins and components -----------------------------------------------------------

def test_join_with_frequent_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id").cache()
    table = spark.range(1, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).cache()
    for how in ("inner", "left"):
        assert sorted(map(str, graph.join_unique(rows, table, "k", how).collect())) == sorted(map(str, rows.join(table, "k", how).collect()))


def test_components_of_a_star_and_a_path(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(200)] + [(9000, 9001)]
    random.Random(1).shuffle(links)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(40)).collect()
    want = dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5201), 5000) | dict.fromkeys((9000, 9001), 9000)
    assert {r.node: r.root for r in got} == want
