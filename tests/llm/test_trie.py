"""The prefix trie against a plain recursive one."""

import hashlib
import random
import zlib

from courtline.llm.prefix_trie import conversation_trie, op13_prefix_trie, subtree_totals
from courtline.llm.store import documents

COLUMNS = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    talks = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        talks[c] = [(r, t) for _, r, t in own.get(base, [])[:h] + turns[h:]]
    nodes = {}
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            nodes.setdefault(tuple(talks[c][:d]), []).append(c)
    order = sorted(nodes, key=len, reverse=True)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node in order:
        leaves[node] += kids[node] == 0
        saved[node] += (len(nodes[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            kids[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(talks[c]) == len(node))
        parent = nodes[node[:-1]][0] if node else None
        out.append((members[0], len(node), parent, len(members), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def awkward():
    rng = random.Random(3)
    say = lambda k=3: rng.choice(["", None, "hi", "é𝄞x", "a longer turn " * 9, *(f"t{i}" for i in range(k))])
    rows = [(c, t, rng.choice(["user", "assistant", None, "x"]), say()) for c in [*range(0, 40), 100, 103, 250, 251, -7, -100, -205, 1 << 40] for t in range(rng.randint(1, 8))]
    rows += [(5, t, "user", f"only {t}") for t in range(8, 150)]  # a long chain
    rows += [(6, t, "user", f"only {t}") for t in range(8, 90)]
    rows += [(c, None, "user", "first of all") for c in (7, 8, 9, 300)] + [(8, 3, "user", "twice"), (8, 3, "user", "twice"), (8, 3, "a", "tie"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(7)]  # copies
    rows += [(500, t, "user", f"spine {t}") for t in range(40)] + [(500 + k, t, "user", f"spine {t}" if t < k else f"off {k}") for k in range(1, 40) for t in range(k + 2)]  # a caterpillar
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k") for r in rows], COLUMNS).repartition(3)


def test_trie(spark):
    rows = awkward()
    assert sorted(map(tuple, conversation_trie(frame(spark, rows), block=4).collect()), key=repr) == brute(rows)


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in documents(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_prefix_trie(spark, sf).collect()), key=repr) == brute(rows)


def test_small_tables(spark):
    assert conversation_trie(frame(spark, [])).count() == 0
    assert conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    for rows in ([(1, 1, "u", "x")], [(0, 1, None, None), (1, 1, "", "")]):
        assert sorted(map(tuple, conversation_trie(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_contraction_of_a_random_tree(spark):
    """Any tree, not only a trie: nodes (i, depth) with weights, a path of 300 among them."""
    rng, parent = random.Random(5), {0: None}
    for i in range(1, 900):
        parent[i] = i - 1 if i < 300 else rng.choice([rng.randrange(i), i - 1, 0])
    depth, kids = {0: 0}, {i: [] for i in parent}
    for i in range(1, 900):
        depth[i] = depth[parent[i]] + 1
        kids[parent[i]].append(i)
    xor = lambda values: __import__("functools").reduce(lambda a, b: a ^ b, values, 0)
    rows = [(i, depth[i], parent[i], None if i == 0 else depth[i] - 1, len(kids[i]), xor(kids[i]), xor(depth[k] for k in kids[i]), int(not kids[i]), i * 3 + 1) for i in parent]
    want_l, want_s = {}, {}
    for i in sorted(parent, reverse=True):
        want_l[i] = int(not kids[i]) + sum(want_l[k] for k in kids[i])
        want_s[i] = i * 3 + 1 + sum(want_s[k] for k in kids[i])
    out = subtree_totals(spark.createDataFrame(rows, "v long, vd long, p long, pd long, n long, cv long, cd long, leaves long, saved long")).collect()
    assert sorted(map(tuple, out)) == sorted((i, depth[i], want_l[i], want_s[i]) for i in parent)
