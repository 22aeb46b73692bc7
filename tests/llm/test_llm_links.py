"""Url filters, preference pairs and revisits."""

import random

import pytest
from helpers import prose

from strandmill.llm import linkgraph, preference, store, warc
from strandmill.llm.oracles import PAGE_RULES

PAGES = "page_id long, url string, html string, rule string, host string, kind string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "r", "h", "k") for r in rows], PAGES)


# ------------------------------------------------------------------------ url filters


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def best_rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(rule), verdict == "block", rule))
    return max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://a.example.org/en/1?x=1",
    "https://example.org/en/2", "https://example.org", "https://org/", "https://x.com/fr/", "https://x.com/de/#a",
    "https://x.com/en/", "https://notorg/", "a://b://org/", "https://ÉX.com/fr/ü", "https://y.org?es/",
    "https://x.com//fr/", "https://z.net/a", "https://user@example.org/es/",
]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_rules(spark, monkeypatch, sent):
    monkeypatch.setattr(linkgraph, "SENT_HOSTS", sent)
    pages = pages_of(spark, [(i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[4], "<a>"), (5, URLS[5], "")])
    got = linkgraph.judge_pages(pages, PAGE_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[4] if r.page_id is None else URLS[r.page_id]
        host, path = split_url(url)
        rule = best_rule(host, path, PAGE_RULES)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule and rule[1])
        if rule:
            assert r.verdict == ("block" if rule[0] else "allow")
        elif not host:
            assert r.verdict == "allow"


def test_equally_long_rules_block(spark):
    pages = pages_of(spark, [(1, "http://a.b/cd", None)])
    rules = [("allow", "a.b/c"), ("block", "b/cd/"), ("block", "a.b/c")]
    assert linkgraph.judge_pages(pages, rules).first().verdict == "block"
    assert linkgraph.judge_pages(pages, []).first().verdict == "allow"
    assert linkgraph.judge_pages(pages_of(spark, []), rules).count() == 0


def scores(links, seeds, rounds=400):
    """Trust and distrust by plain iteration."""
    hosts = {h for e in links for h in e[:2]} | {h for h, _, _ in seeds}
    out = []
    for flip, at in ((False, 1), (True, 2)):
        edges = [(b, a, n) if flip else (a, b, n) for a, b, n in links]
        total = {h: sum(n for a, _, n in edges if a == h) for h in hosts}
        base = {h: 0.15 * sum(s[at] for s in seeds if s[0] == h) for h in hosts}
        now = dict(base)
        for _ in range(rounds):
            new = dict(base)
            for a, b, n in edges:
                new[b] += 0.85 * now[a] * n / total[a]
            now = new
        out.append(now)
    return {h: (out[0][h], out[1][h]) for h in hosts}


def test_propagation_equals_plain_iteration(spark):
    rng = random.Random(1)
    links = {(f"h{rng.randrange(25)}", f"h{rng.randrange(25)}") for _ in range(70)}
    links = [(a, b, rng.randrange(1, 9)) for a, b in sorted(links) if a != b]
    seeds = [("h1", 5, 0), ("h2", 1, 4), ("h3", 0, 7), ("lonely", 2, 2)]
    got = linkgraph.propagate(
        spark.createDataFrame(links, "src string, dst string, n long"),
        spark.createDataFrame(seeds, "host string, allowed long, blocked long"), tolerance=1e-4)
    want = {h: s for h, s in scores(links, seeds).items() if any(s)}
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    for host, pair in want.items():
        assert found.get(host, (0, 0)) == pytest.approx(pair, abs=1e-3)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    links = [(f"h{i:02d}", f"h{i + 1:02d}", 1) for i in range(60)]
    seeds = [("h60", 0, 1)]
    got = linkgraph.propagate(
        spark.createDataFrame(links, "src string, dst string, n long").coalesce(1),
        spark.createDataFrame(seeds, "host string, allowed long, blocked long"))
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert len(found) == 61
    for host, (trust, distrust) in scores(links, seeds).items():
        assert found[host] == (trust, pytest.approx(distrust, rel=1e-9))
    assert 0.85 ** linkgraph.rounds_to() <= linkgraph.TOLERANCE < 0.85 ** (linkgraph.rounds_to() - 1)


def test_distrust_flows_backwards(spark):
    link = '<a class=x HREF = "{}">t</a> <a href=\'/local\'> <a href="mailto:x">'
    rows = [
        (1, "http://seller.net/a", link.format("https://bad.com/de/x")),
        (2, "http://bad.com/de/1", link.format("//friend.net/")),
        (3, "http://good.org/x", link.format("http://Friend.net:80/y") + link.format("http://friend.net")),
        (4, "http://friend.net/", None), (5, "http://apart.net/", link.format("http://apart.net/other")),
    ]
    links = {(r.src, r.dst): r.n for r in linkgraph.host_links(pages_of(spark, rows)).collect()}
    assert links == {("seller.net", "bad.com"): 1, ("bad.com", "friend.net"): 1,
                     ("good.org", "friend.net:80"): 1, ("good.org", "friend.net"): 1}
    got = {r.page_id: r.verdict for r in linkgraph.judge_pages(pages_of(spark, rows), PAGE_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


# ------------------------------------------------------------------------ preference pairs

TURNS = "pair_id long, side string, turn long, role string, text string, n int, chosen string"


def rendered(turn):
    return f"<|{turn[1] or ''}|>\n{turn[2] or ''}<|end|>\n"


def expected_pair(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    out = [n, "".join(map(rendered, a[:n]))]
    masks = []
    for rest in (a[n:], b[n:]):
        out.append("".join(map(rendered, rest)))
        at, spans = 0, []
        for t in rest:
            if t[1] == "assistant":
                spans.append((at + len(f"<|{t[1]}|>\n"), at + len(rendered(t))))
            at += len(rendered(t))
        masks.append(spans)
    return (*out, *masks)


def test_pairs(spark):
    u, s = "user", "assistant"
    pairs = {
        1: ([(0, u, "hi"), (1, s, "yes"), (2, u, "more"), (3, s, "ünï")], [(0, u, "hi"), (1, s, "no")]),
        2: ([(0, u, "x")], [(0, u, "x")]), 3: ([(0, None, None)], [(0, None, None), (1, s, None)]),
        4: ([], [(0, s, "only")]), 5: ([(0, u, "a"), (1, s, "b")], []),
        6: ([(0, u, ""), (1, s, "x" * 30000)], [(0, u, ""), (1, s, "x" * 30000), (2, s, "y")]),
        7: ([(0, s, "a")], [(0, u, "a")]), 8: ([(0, u, prose(1, 30)), (5, s, "late")], [(0, u, prose(1, 30)), (7, s, "late")]),
    }
    rows = [(p, side, *t, 1, "c") for p, ab in pairs.items() for side, ts in zip(("chosen", "rejected"), ab) for t in ts]
    rows += [(1, "chosen", 0, u, "hi", 1, "c"), (None, "chosen", 0, u, "hi", 1, "c"), (1, "other", 0, u, "q", 1, "c"),
             (1, None, 0, u, "q", 1, "c"), (1, "chosen", None, u, "q", 1, "c")]
    random.Random(2).shuffle(rows)
    got = preference.preference_pairs(spark.createDataFrame(rows, TURNS)).collect()
    spans = lambda m: [(x.start, x.stop) for x in m]
    found = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, spans(r.chosen_mask),
                         spans(r.rejected_mask)) for r in got}
    assert found == {p: expected_pair(a, b) for p, (a, b) in pairs.items()}
    for r in got:
        assert all(r.chosen[x.start:x.stop].endswith("<|end|>\n") for x in r.chosen_mask)
    assert preference.preference_pairs(spark.createDataFrame([], TURNS)).count() == 0


def plain_sides(rows):
    """Both sides of every conversation, as lists of (turn, role, text)."""
    order = lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    turns = {}
    for conv, *t in rows:
        if conv is not None and t[0] is not None:
            turns.setdefault(conv, set()).add(tuple(t))
    last = {}
    for conv, found in turns.items():
        said = [t for t in found if t[1] == "assistant"]
        if said:
            last[conv] = max(said, key=lambda t: (t[0], t[2] is not None, t[2] or ""))
    out = {}
    for conv, found in turns.items():
        rejected = set()
        for t in found:
            if conv in last and t[0] > last[conv][0]:
                continue
            if conv in last and t[0] == last[conv][0] and t[1] == "assistant":
                if conv ^ 1 in last:
                    rejected.add((t[0], t[1], last[conv ^ 1][2]))
                continue
            rejected.add(t)
        out[conv] = (sorted(found, key=order), sorted(rejected, key=order))
    return out


def test_every_conversation_is_a_pair(spark):
    u, s = "user", "assistant"
    rows = [
        (0, 0, u, "a"), (0, 1, s, "b"), (0, 2, u, "c"), (1, 0, u, "d"), (1, 1, s, "e"),  # partners
        (2, 0, u, "f"), (2, 1, s, "g"), (3, 0, u, "only a user"),  # one without an assistant
        (4, 0, s, "no partner"), (6, 0, u, None), (7, 0, None, "x"), (9, 0, s, None), (8, 3, s, "p"), (8, 3, s, "q"), (8, 3, u, "r"),
        (10, 0, u, "same"), (10, 1, s, "end"), (11, 0, u, "same"), (11, 1, s, "end"), (11, 1, s, "end"),
        (None, 0, s, "lost"), (12, None, s, "lost"), (14, 0, u, prose(1, 30_000)), (14, 1, s, prose(2, 30_000)),
    ]
    table = spark.createDataFrame([(*r, "c", 5) for r in rows], "conv_id long, turn long, role string, text string, other string, last_turn int")
    got = preference.preference_pairs(preference.pairs_from_conversations(table)).collect()
    spans = lambda m: [(x.start, x.stop) for x in m]
    found = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, spans(r.chosen_mask),
                         spans(r.rejected_mask)) for r in got}
    assert found == {c: expected_pair(a, b) for c, (a, b) in plain_sides(rows).items()}
    assert set(found) == {0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 14}
    assert found[4][3] == "" and found[3][2:4] == ("", "")
    assert preference.pairs_from_conversations(table.limit(0)).count() == 0


# ------------------------------------------------------------------------ revisits

RECORDS = ("record_id long, warc_type string, target_uri string, warc_date long, status int, profile string, "
           "headers string, payload_digest string, found string, part int")


def test_canonical_urls(spark):
    same = [
        "http://Example.com/a/?b=2&a=1", "https://www.example.com:443/a?a=1&b=2#x", "HTTPS://u:p@example.com:80/a//?a=1&&b=2&utm_source=z",
    ]
    other = [None, "", "x", "http://", "http:///a", "http://example.com/A", "http://example.com:8080/a", "http://example.com/a?a=1"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string")
    got = [r[0] for r in df.select(warc.canonical_url(df.u)).collect()]
    assert set(got[:3]) == {"example.com/a?a=1&b=2"}
    assert got[3:] == [None] * 5 + ["example.com/A", "example.com:8080/a", "example.com/a?a=1"]


def expected_revisits(rows):
    out = []
    for r in rows:
        if r[1] != "revisit" or r[5] != warc.NOT_MODIFIED:
            continue
        full = [x for x in rows if x[1] == "response" and x[4] == 200 and x[2] and x[2] == r[2]
                and None not in (x[3], r[3]) and x[3] < r[3]]
        if not full:
            out.append((r[0], "missing", None, None))
            continue
        last = max(full, key=lambda x: (x[3], x[0]))
        own, theirs = (dict(line.split(": ", 1) for line in (x[6] or "").lower().split("\n") if ": " in line) for x in (r, last))
        strip = lambda t: t and t.removeprefix("w/")
        if "etag" in own:
            ok = strip(own["etag"]) == strip(theirs.get("etag"))
        else:
            ok = "last-modified" in own and own["last-modified"] == theirs.get("last-modified")
        merged = theirs | {k: v for k, v in own.items() if k in warc.PERMITTED}
        out.append((r[0], "resolved", last[0], "\n".join(sorted(f"{k}: {v}" for k, v in merged.items())))
                   if ok else (r[0], "changed", None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_revisits_equal_brute_force(spark, seed):
    """Most records are of one URL, spread over all ranges."""
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot.net/a"] * 6 + [f"http://h{rng.randrange(9)}.net/", None, "none"])
        date = rng.choice([None] + [rng.randrange(150) for _ in range(30)])
        head = rng.choice(["etag: \"a\"", "ETag: W/\"a\"", "etag: \"b\"", "last-modified: x", "server: z", "", None])
        head = head and f"{head}\ncontent-type: t{i % 3}\nexpires: e{i}\ndate: d{i}"
        if i % 2:
            rows.append((i, "revisit", url, date, 304, rng.choice([warc.NOT_MODIFIED] * 5 + ["other", None]), head, None, "f", 1))
        else:
            rows.append((i, "response", url, date, rng.choice([200, 200, 200, 404, None]), None, head, f"p{i}", "f", 1))
    canonical = [(*r[:2], r[2] and r[2].startswith("http") and r[2] or None, *r[3:]) for r in rows]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(5)).collect()
    assert sorted((r.record_id, r.outcome, r.refers_to, r.headers and r.headers.lower()) for r in got) == sorted(expected_revisits(canonical))
    assert {r.outcome for r in got} == {"resolved", "changed", "missing"}
    assert all(r.payload_digest == (f"p{r.refers_to}" if r.refers_to is not None else None) for r in got)


def test_repeated_records_and_none(spark):
    full = (2, "response", "http://a.b/", 1, 200, None, "etag: x", "p", "f", 1)
    ask = (3, "revisit", "http://a.b", 2, 304, warc.NOT_MODIFIED, "etag: x", None, "f", 1)
    got = warc.resolve_revisits(spark.createDataFrame([full, full, ask, ask], RECORDS)).collect()
    assert [(r.record_id, r.outcome, r.refers_to) for r in got] == [(3, "resolved", 2)] * 2
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_hints_follow_sizes(spark):
    table = store.stored(spark.range(5), "five")
    assert store.how_to_send(table, 5) == "broadcast" and store.how_to_send(table, 4) == "merge"
