"""Operators over the whole corpus, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import chat_tree, context_tree, decontam, exact, graph, near_dup, substring


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- exact dedup


def check_exact(got, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            want[(i, first, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup(docs, rows, none):
    check_exact(exact.exact_dedup(docs).collect(), rows)
    check_exact(exact.exact_dedup(docs, support=0.05).collect(), rows)
    assert exact.exact_dedup(none).count() == 0
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})


# -- near-duplicates


def brute_components(rows, threshold=75):
    sets = {}
    for i, t in rows:
        w = words(ascii_lower(t))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, all_ in sets.items() for s in all_ if i is not None and s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            n = len(a & b)
            if 100 * n >= threshold * (len(a) + len(b) - n) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return Counter((i, len(s), None if i is None else find(i), None if i is None else find(i) == i) for i, all_ in sets.items() for s in all_)


def test_near_duplicates(docs, rows, none):
    assert Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect()) == brute_components(rows)
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_in_long_lists(spark):
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(150)] = f"v{rnd.randrange(9999)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(base[:60] + [f"u{k}x{j}" for j in range(60)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dup.near_duplicates(df).collect()) == brute_components(rows)


def test_small_sets_lose_nothing(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))) for k in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dup.near_duplicates(df).collect()) == brute_components(rows)


def test_rows_that_repeat_an_id_are_one_document(spark):
    left, right = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, left), (5, right), (1, f"{left} x"), (2, f"{right} y"), (9, None), (9, "alone here")]
    for some in (rows, rows[::-1]):
        got = Counter(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect())
        assert got == brute_components(some)
        assert {r[2] for r in got if r[0] in (1, 2, 5)} == {1}


def test_long_lists_give_more_pairs_round_by_round(spark, monkeypatch):
    """Unlike texts share a passage that fills the sketches' lists; few pairs a round still find all links."""
    monkeypatch.setattr(near_dup, "FIRST", 1)
    monkeypatch.setattr(near_dup, "MORE", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rnd = random.Random(8)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for k in range(14):
        own = [f"g{k}w{j}" for j in range(40)]
        for j in range(4):
            w = passage + own
            w[70 + rnd.randrange(40)] = f"e{k}x{j}"
            rows.append((10 * k + j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dup.near_duplicates(df).collect()) == brute_components(rows)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), few=0).collect()} == got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- substring dedup


def test_remove_repeats(docs, rows, none):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, i), i)
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert Counter(tuple(r) for r in substring.remove_repeats(docs).collect()) == want
    assert sum(k[2] for k in want) > 500
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 8, 31, 50])
def test_equal_runs_have_equal_hashes(n):
    w = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = substring.Windows(w, max(n, 8)).runs(n, substring._SEEDS[0])
    assert len(h) == 401 - n
    same = defaultdict(set)
    for k in range(len(h)):
        same[tuple(w[k : k + n])].add(int(h[k]))
    assert all(len(v) == 1 for v in same.values()) and len({*h.tolist()}) == len(same)


# -- decontamination


def brute_leaks(rows, items):
    W = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    S = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    found = {}
    for item, t in items:
        b = W(t)
        if not b:
            continue
        k = min(5, len(b))
        for i, text in rows:
            w = W(text)
            best = 0.0
            for s in range(max(0, len(w) - len(b)) + 1):
                x, y = Counter(S(w[s : s + len(b)], k)), Counter(S(b, k))
                total = sum((x | y).values())
                best = max(best, sum((x & y).values()) / total if total else 0.0)
            if best >= 0.75:
                found[(i, item)] = max(round(best, 6), found.get((i, item), 0))
    return found


def test_decontamination(spark, docs, rows, none):
    base = next(t for i, t in rows if i == 12).split()
    near = base[30:60]
    near[2] = "other"
    items = [(1, " ".join(base[30:60])), (2, " ".join(near)), (3, "One, two"), (4, None), (5, ""), (6, "never seen words of this item here"), (7, " ".join(base[20:50]).upper() + "!")]
    df = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, df).collect()}
    assert got == brute_leaks(rows, items) and len(got) > 5
    clean = decontam.drop_contaminated(docs, df)
    assert clean.columns == docs.columns and clean.count() == sum(i not in {k[0] for k in got} for i, _ in rows)
    assert decontam.contaminated(none, df).count() == 0 and decontam.contaminated(docs, df.limit(0)).count() == 0


def test_decontamination_of_reordered_passages(spark):
    w = lambda c, n: [f"{c}{k}" for k in range(n)]
    a, b, c, long = w("a", 20), w("b", 20), w("c", 30), w("d", 120)
    items = [(1, " ".join(a + b)), (2, " ".join(c)), (3, " ".join(long))]
    rows = [
        (1, " ".join(w("x", 60) + b + a + w("y", 60))), (2, " ".join(b + a)), (3, " ".join(w("x", 9) + a + w("y", 3) + b)), (4, " ".join(w("x", 7) + c + w("y", 5) + c[:28] + ["z", "z"])),
        (5, " ".join(long[70:] + long[:70])), (6, " ".join(w("x", 40) + long[80:] + long[40:80] + long[:40] + w("y", 40))), (7, " ".join(long[:100])), (8, " ".join(c[15:] + c[:15])),
        (9, " ".join(a + b)), (9, " ".join(w("x", 20) + b + a)), (10, " ".join(w("x", 30) + a)),
    ]
    df = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, df).collect()}
    assert got == brute_leaks(rows, items)
    assert {(1, 1), (5, 3), (6, 3)} <= got.keys()


def test_blocks_cover_the_fingerprint():
    assert len(decontam.MASKS) == decontam.RADIUS + 1
    total = 0
    for m in decontam.MASKS:
        assert not total & (m & (1 << 64) - 1)
        total |= m & (1 << 64) - 1
    assert total == (1 << 64) - 1


# -- context tree


def brute_tree(texts, depth, leaves):
    """The same mixture, node by node in plain Python."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    total = 0
    for t in texts:
        x = bytes(depth) + t
        for k in range(depth, len(x)):
            total += 1
            for d in range(depth + 1):
                counts[d][x[k - d : k]][x[k]] += 1
    often = [{c for c, n in level.items() if sum(n.values()) >= max(1.0, total / leaves)} for level in counts]

    def split(n):
        out = Counter()
        for s, c in n.items():
            for level in range(8):
                out[(level, s >> (8 - level), (s >> (7 - level)) & 1)] += c
        return out

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def children(d, c):
        return [x for x in often[d + 1] if x[1:] == c] if d < depth else []

    def rest(d, c):
        left = Counter(counts[d][c])
        for x in children(d, c):
            left.subtract(counts[d + 1][x])
        return split(+left)

    def weighted(d, c, node):
        n = split(counts[d][c])
        own = kt(n[(*node, 0)], n[(*node, 1)])
        kids = children(d, c)
        if not kids:
            return own, None
        r = rest(d, c)
        below = kt(r[(*node, 0)], r[(*node, 1)]) + sum(weighted(d + 1, x, node)[0] for x in kids)
        m = max(own, below)
        return m + math.log(math.exp(own - m) + math.exp(below - m)) - math.log(2), math.exp(own - below)

    def one(before, node):
        """Probability of a one after these bytes."""

        def down(d, c):
            n = split(counts[d][c])
            own = (n[(*node, 1)] + 0.5) / (n[(*node, 0)] + n[(*node, 1)] + 1)
            _, r = weighted(d, c, node)
            if r is None:
                return own
            deeper = before[len(before) - d - 1 :]
            if deeper in often[d + 1]:
                p = down(d + 1, deeper)
            else:
                n = rest(d, c)
                p = (n[(*node, 1)] + 0.5) / (n[(*node, 0)] + n[(*node, 1)] + 1)
            return (r * own + p) / (1 + r)

        return down(0, b"")

    def score(text):
        x, out = bytes(depth) + text, 0.0
        for k in range(depth, len(x)):
            for level in range(8):
                p = one(x[k - depth : k], (level, x[k] >> (8 - level)))
                out += math.log10(p if (x[k] >> (7 - level)) & 1 else 1 - p)
        return out

    return score


def test_tree_equals_plain_mixture(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "DEPTH", 3)
    texts = ["abracadabra abra", "banana band", "", "cab é"]
    levels = []
    joined = [bytes(3) + t.encode() for t in texts]
    counts = [defaultdict(lambda: np.zeros(256)) for _ in range(4)]
    for x in joined:
        for k in range(3, len(x)):
            for d in range(4):
                counts[d][int.from_bytes(x[k - d : k], "big")][x[k]] += 1
    total = sum(c.sum() for c in counts[0].values())
    for level in counts:
        kept = {c: n for c, n in level.items() if n.sum() >= max(1.0, total / 12)}
        levels.append((np.array(list(kept), dtype=np.int64), np.array(list(kept.values()))))
    tree, plain = context_tree.build(levels), brute_tree([t.encode() for t in texts], 3, 12)
    for t in ("abra band", "zzz", "é", "cabana"):
        assert tree.score(t.encode()) == pytest.approx(plain(t.encode()), rel=1e-4)
    assert tree.score(b"") == 0.0
    total = sum(10 ** tree.score(b"ab" + bytes([c])) for c in range(256))
    assert total == pytest.approx(10 ** tree.score(b"ab"), rel=1e-3)


def test_scores(spark, docs, rows, none):
    tokens = lambda t: words(ascii_lower(t)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for i, t in rows)
    got = context_tree.score(docs, chunk=3000).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all((r.score < 0) == (r.bits_per_byte is not None) for r in got)
    assert context_tree.score(none).count() == 0


def test_tree_learns_from_training_rows_only(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    train = [k for k in range(400) if k not in ids]
    df = spark.createDataFrame([(k, "the same text again and again") for k in train[:100]] + [(ids[0], "the same text again"), (ids[1], "QQQQ zzzz 0000")], "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in context_tree.score(df).collect()}
    assert got[ids[0]] < 1.0 < 6.0 < got[ids[1]]


def test_rare_contexts_are_nodes_at_every_size(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=5000))) for k in range(12)] + [(k, "seldom quoted phrase") for k in range(12, 16)] + [(16, ""), (17, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows.append((next(k for k in range(100, 200) if held(k)), "a seldom quoted phrase, zzz"))
    counts = [defaultdict(lambda: np.zeros(256)) for _ in range(7)]
    for i, t in rows:
        x = bytes(6) + (t or "").encode()
        for k in range(6, len(x) if not held(i) else 0):
            for d in range(7):
                counts[d][int.from_bytes(x[k - d : k], "big")][x[k]] += 1
    total = sum(c.sum() for c in counts[0].values())
    assert total / 65536 > 4  # a share of the corpus would drop the phrase
    tree = context_tree.build([(np.array(list(c), dtype=np.int64), np.array(list(c.values()))) for c in counts])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in context_tree.score(df, chunk=50_000).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == pytest.approx(tree.score((t or "").encode()), rel=1e-4, abs=1e-6)


# -- chat tree


def test_chat_tree(spark, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    hi, ok = ("user", "hi"), ("assistant", "ok")
    convs = {
        1: [hi, ok, ("user", "more")], 2: [hi, ok], 3: [hi, ok, ("user", "more"), ("assistant", "")], 4: [hi, ("assistant", "no")], 5: [(None, None)],
        6: [("user", "</s>[INST] ok [/INST]"), ("assistant", r"<\s>[\\INST]<|endoftext|><\|endoftext|>"), ("[/INST]", "é😀\n<")], 7: [hi, ok, ("user", "more")], 8: [("assistant", "x" * 5000)],
        9: [(("user", "assistant")[k % 2], f"turn {k}") for k in range(120)], 10: [(("user", "assistant")[k % 2], f"turn {k}") for k in range(60)] + [("user", "branch")],
        None: [("user", "null id")],
    }
    turns = [(c, k, r, t, "x") for c, conv in convs.items() for k, (r, t) in enumerate(conv)]
    random.Random(0).shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, node string").repartition(5)
    nodes, members = chat_tree.prefix_tree(df, path)
    stream = sorted(nodes.collect(), key=lambda n: n.offset)
    prefixes = {tuple((r or "", t or "") for r, t in conv[: k + 1]) for conv in convs.values() for k in range(len(conv))}
    assert len(stream) == len(prefixes) == len({n.node for n in stream})
    at, place = 0, {n.node: n for n in stream}
    for n in stream:
        assert n.offset == at and n.n_tokens == len(n.tokens)
        at += n.n_tokens
        chain, up = [], n.parent
        while up:
            chain.insert(0, place[up])
            up = place[up].parent
        assert sum(x.n_tokens for x in chain) == n.position and len(chain) == n.depth
        assert {t for a in n.attends for t in range(a["from"], a["to"])} == {t for x in chain for t in range(x.offset, x.offset + x.n_tokens)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat_tree.read_back(nodes, members, path).collect()}
    assert got.keys() == convs.keys()
    for c, conv in convs.items():
        loss = "".join(t or "" for r, t in conv if r == "assistant")
        chars = sum(len("".join(chat_tree.format_turn(r or "", t or ""))) for r, t in conv)
        assert tuple(got[c]) == (c, len(conv), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in conv)), len(loss), sha(loss), chars)
    nodes, members = chat_tree.prefix_tree(df.limit(0), path)
    assert nodes.count() == 0 and chat_tree.read_back(nodes, members, path).count() == 0


@pytest.mark.parametrize("text", ["</s>", r"<\/s>", r"[\\INST]", "<<|endoftext|>", "[[INST]", "\\", "<", "<s><s>"])
def test_escapes_can_be_taken_back(text):
    assert chat_tree.unescape(chat_tree.escape(text)) == text
    assert chat_tree.parse("".join(chat_tree.format_turn(text, text)) * 2) == [(text, text)] * 2
