import math
import random
import struct
from collections import Counter, defaultdict
from zlib import crc32

import xxhash

from loomstat.llm import sharding, url_filter

from .helpers import docs, edge_rows, prose


def judge(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.com/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/1", "http://example.com/EN/",
    "http://xexample.com/en/", "http://example-x.com/en/", "x://net/es/?q", "http://a.b.net/fr/", "http://net.org/es/", "http://a..com/", "http://.com/", "http://example.com?en/", "http://example.com#/en/",
    "http://example.com:80/en/", "http://user@example.com/en/", "a://b://com/", "http://com./", "http://É.com/en/", "http://www.example.com/en/", "http://example.com/en",
]


def test_urls_match_brute_force(spark):
    rules = url_filter.RULES + [("b.example.com", "/", "block"), ("com", "/en/deep/", "block")]
    rows = [(i, u, "h", "k", 1) for i, u in enumerate(URLS * 3)] + [(1, URLS[7], "h", "k", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, key string, salt int")
    rule_table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for per in (2_000, 3):
        got = url_filter.filter_urls(table, rule_table, per_salt=per).collect()
        assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((i, *judge(u, rules)) for i, u, *_ in rows)))
    assert url_filter.filter_urls(table.limit(0), rule_table).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(table, rule_table.limit(0), default="block").collect()} == {"block"}


def test_shards_are_even_gapless_and_whole(spark):
    rows = edge_rows() + [(1000 + i, "copy of one text", "s") for i in range(300)] + [(2000 + i, prose(i % 150, 40), "s") for i in range(450)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    want = Counter((str(i), len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs(spark, rows).limit(0)).count() == 0


def test_links_are_kept_together_and_sizes_equal(spark):
    rows = [(i, prose(i % 900, 60), "s") for i in range(1800)] + [(9000 + i, "hot " * 50, "s") for i in range(900)]
    placed = sharding.shard_documents(docs(spark, rows), n_shards=8)
    sizes = [r["sum(size)"] for r in placed.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8
    r = sharding.cut_links(placed).first()
    assert r["cut"] <= 0.02 * r["groups"] + 1  # only the hot group has to be cut, and what stands at a border


def spark_hash(*values):
    """xxhash64 of longs ("q") and ints ("i"), as (format, value)."""
    seed = 42
    for form, value in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + form, value), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_propagation(mass, n_shards, capacity):
    """mass {(link, unit): {shard: bytes}} when no unit finds a shard with room any more."""
    while True:
        loads, hubs, asks = Counter(), defaultdict(Counter), defaultdict(list)
        for (link, _), here in mass.items():
            loads.update(here)
            hubs[link].update(here)
        for (link, unit), here in mass.items():
            total = sum(here.values())
            fits = [(near, capacity - loads[s], spark_hash(("q", unit), ("i", s)), s) for s, near in hubs[link].items() if total - here.get(s, 0) <= capacity - loads[s]]
            if len(here) > 1 and fits:
                near, _, _, s = max(fits)
                rank = sharding.ORDER_CELLS - 1 - min(sharding.ORDER_CELLS // 4 - 1, math.floor(math.log2(near))) * 4 - spark_hash(("q", unit)) % 4
                asks[s].append((rank, -near, unit, total - here.get(s, 0), link))
        moves = {}
        for s, queue in asks.items():
            before = 0
            for _, _, unit, more, link in sorted(queue):
                if before + more <= capacity - loads[s]:
                    moves[link, unit] = s
                before += more
        if not moves:
            return mass
        mass = {key: {moves[key]: sum(here.values())} if key in moves else here for key, here in mass.items()}


def test_propagation_matches_plain_rounds(spark):
    for seed, spare in ((1, 1.0), (2, 1.0), (3, 1.3)):
        rng, mass = random.Random(seed), {}
        for unit in range(160):
            link = unit if unit < 120 else 1000 + unit % 3  # three groups of many units, and groups of one
            mass[link, unit] = {s: rng.choice([1, 5, 5, 40, 300]) for s in rng.sample(range(6), rng.randrange(1, 5))}
        capacity = spare * sum(sum(h.values()) for h in mass.values()) / 6
        table = spark.createDataFrame([(k, u, s, b) for (k, u), here in mass.items() for s, b in here.items()], "link long, unit long, shard int, bytes long")
        got = defaultdict(dict)
        for r in sharding._propagate(table, 6, capacity).collect():
            got[r.link, r.unit][r.shard] = r.bytes
        assert got == plain_propagation(mass, 6, capacity)
