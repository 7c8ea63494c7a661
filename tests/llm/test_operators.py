"""The ten operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import sys
import warnings
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SMALL  # noqa: E402

from lexiweave.llm import exact_dedup, license_scan, mixing, packing, passage_dedup, quality_rules, sharding, simhash, toxicity, url_filter  # noqa: E402
from lexiweave.llm.common import table  # noqa: E402
from lexiweave.llm.components import connected_components  # noqa: E402

#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text, and columns whose names could clash.
random.seed(4)
LONG = " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.randrange(900)) for _ in range(9000))
ODD = [(1, "", "a"), (2, None, "a"), (3, " \t\n", None), (4, "a b  c", "b"), (5, "ab c", "b"), (5, "ab c", "b"), (None, "abc", "b"), (7, LONG, None), (8, LONG + " x", "c"), (9, "日本語 テスト É é", "c"), (None, None, None)]
SCHEMA = "doc_id long, text string, source string, k string, x long, uid long, node long, fp long, id long, size long, rate double, toxic int, domain int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, 6, 0.5, 1, 2) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def vocabulary():
    return packing.vocabulary_path()


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(200))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    from lexiweave.llm.tokenize import WordBpe

    bpe, exact, rng = WordBpe(vocabulary(), cache_bytes=4000), Tokenizer.from_file(vocabulary()), random.Random(1)
    pool = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA1, 0x250))] * 2 + list("日é́ \x1c\x85")
    cases = ["".join(rng.choices(pool, k=rng.randrange(50))) for _ in range(600)] + ["", "it's 'tis don't", "a <|endoftext|> b", LONG[:3000]]
    for t in cases:
        assert bpe.encode(t) == np.array(exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def check_packing(rows, rest):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary())
    seqs, seen = collections.defaultdict(list), collections.Counter()
    pieces = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for d, text in rest.items():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(i // 4096, i, min(4096, len(ids) - i), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[d]) == want
    return len(seqs), sum(r.length for r in rows)


def test_packing(spark, docs, texts, odd, nothing):
    n, total = check_packing(packing.pack_documents(docs, vocabulary()).collect(), texts)
    assert n == -(-total // 4096)
    assert n <= 1.03 * -(-total // 4096) + 1
    rows = packing.pack_documents(odd, vocabulary()).collect()
    assert collections.Counter(r.doc_id for r in rows)[5] == 2 and sum(r.doc_id is None for r in rows) == 2
    check_packing(rows, {d: t for d, t, _ in ODD if d in (1, 2, 3, 4, 7, 9)})
    assert packing.pack_documents(nothing, vocabulary()).count() == 0
    pieces = spark.range(4000).selectExpr("id as doc_id", "1 + pmod(hash(id), 4096) as length").selectExpr("doc_id", "cast(length as long) length")
    many = packing.pack(pieces, group_pieces=256).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in many) <= 4096 and len({r[0] for r in many}) <= 1.03 * sum(r[1] for r in many) / 4096


def test_reopened_bins():
    rng = np.random.default_rng(4)
    for n, low in ((400, 1), (300, 900), (50, 2100), (1, 1), (0, 1)):
        sizes = rng.integers(low, 4096, n)
        before, _ = packing.sum_of_squares(sizes, 4096)
        where = packing.reopen(sizes, before, 4096)
        offset = packing.offsets(sizes, where)
        assert len(np.unique(where)) <= len(np.unique(before))
        for b in np.unique(where):
            at = np.argsort(offset[where == b])
            assert offset[where == b][at].tolist() == (np.cumsum(sizes[where == b][at]) - sizes[where == b][at]).tolist() and sizes[where == b].sum() <= 4096


def test_sum_of_squares_rule():
    """Each placement against the rule written out: squared counts of open bins, all choices tried."""
    rng, cap = random.Random(3), 20
    sizes = [rng.randrange(1, 20) for _ in range(150)]
    where, _ = packing.sum_of_squares(np.array(sizes), cap)
    gaps: dict[int, int] = {}
    for s, b in zip(sizes, where.tolist()):
        def cost(g):
            n = collections.Counter(v for k, v in gaps.items() if v)
            if g < cap:
                n[g] -= 1
            if g - s:
                n[g - s] += 1
            return sum(v * v for v in n.values())

        choices = {v for v in gaps.values() if v >= s} | {cap}
        assert cost(gaps.get(b, cap)) == min(cost(g) for g in choices)
        gaps[b] = gaps.get(b, cap) - s


def test_urls(spark):
    urls = ["http://A.B.Example.ORG/es/x?q#f", "https://example.org/en/1", "https://x.example.org/en/2", "ftp://org", "http://org?x/", "no scheme", "", None, "http://shop.com/fr/1", "a://b://c/d", "http://notexample.org:80/es/", "http://com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(2, 1)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, outcomes).collect()}
    assert got[0] == ("a.b.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3] == ("org", "", None, "allow") and got[4] == ("org", "", None, "allow") and got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][2:] == ("com/fr/", "allow") and got[9][:2] == ("b:", "//c/d") and got[10] == ("notexample.org:80", "/es/", None, "allow") and got[11][2:] == ("com/de/", "block")
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0 and url_filter.judge(pages, outcomes.limit(0)).count() == len(urls)


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.net/{i}") for i in range(200)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(120)], "page_id long, bad int")
    got = url_filter.judge(pages, outcomes).collect()
    assert {(r.host, r.verdict) for r in got} == {("bad.net", "block"), ("good.net", "allow")}


def reputation_by_hand(rows, tail=0.05, limit=0.5):
    """The three levels written out: (host, n, bad) to (rate, blocked)."""
    from math import lgamma

    def strength(level):
        groups = [(n, k, m) for n, k, m in level]
        scatter, sampling, weight = sum(n * (k / n - m) ** 2 for n, k, m in groups), sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for n, _, m in groups)
        if len(groups) < 2 or weight - sampling <= 0:
            return 10.0
        return 1 / min(max((scatter - sampling) / (weight - sampling), 1e-3), 0.5) - 1

    def quantile(a, b):
        grid = np.linspace(0, 1, 400_001)[1:-1]
        density = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid) - (lgamma(a) + lgamma(b) - lgamma(a + b)))
        return grid[np.searchsorted(np.cumsum(density) / density.sum(), tail)]

    hosts, domains, suffixes = {}, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for host, n, bad in rows:
        suffix, domain = host.split(".")[-1], ".".join(host.split(".")[-2:])
        hosts[host] = (n, bad, suffix, domain)
        for level, name in ((domains, domain), (suffixes, suffix)):
            level[name][0] += n
            level[name][1] += bad
    overall = (sum(b for _, b in suffixes.values()) + 0.5) / (sum(n for n, _ in suffixes.values()) + 1)
    s = strength([(n, b, overall) for n, b in suffixes.values()])
    suffix_mean = {k: (b + s * overall) / (n + s) for k, (n, b) in suffixes.items()}
    s = strength([(n, b, suffix_mean[k.split(".")[-1]]) for k, (n, b) in domains.items()])
    domain_mean = {k: (b + s * suffix_mean[k.split(".")[-1]]) / (n + s) for k, (n, b) in domains.items()}
    s = strength([(n, b, domain_mean[d]) for n, b, _, d in hosts.values()])
    out = {}
    for h, (n, b, _, d) in hosts.items():
        a, c = b + s * domain_mean[d], n - b + s * (1 - domain_mean[d])
        out[h] = (n, b, a / (a + c), quantile(a, c))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reputation_against_hand(spark, seed):
    """Random hosts on three levels: one with a third of all pages, many with a single page, domains of one host, equal counts."""
    rng = random.Random(seed)
    rows = [("www.huge.com", 300, 20 + 100 * seed)]
    for i in range(40):
        n = rng.choice([1, 1, 1, 2, 5, 30])
        rows.append((f"h{i}.d{i % 13}.{rng.choice(['com', 'net', 'org'])}", n, rng.choice([0, n, rng.randrange(n + 1)])))
    pages = [(h, k < bad) for h, n, bad in rows for k in range(n)]
    p = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "page_id long, host string")
    o = spark.createDataFrame([(i, int(b)) for i, (_, b) in enumerate(pages)] + [(10**6, 1)], "page_id long, bad int")
    got = {r.host: r for r in url_filter.reputation(p.repartition(7), o).collect()}
    want = reputation_by_hand(rows)
    assert set(got) == set(want)
    for h, (n, bad, rate, bound) in want.items():
        r = got[h]
        assert (r.n, r.bad) == (n, bad) and abs(r.rate - rate) < 1e-9 and abs(r.bound - bound) < 2e-3  # the sum on a grid is coarse at the ends
        assert r.blocked == (r.bound > url_filter.LIMIT) and (abs(bound - url_filter.LIMIT) < 3e-3 or r.blocked == (bound > url_filter.LIMIT))


def test_urls_on_odd_rows(spark):
    """Repeated rows, null ids, clashing columns: each row once, outcomes counted once a page and host."""
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.net/y"), (None, None), (2, "http://b.net/" + "z" * 100000), (3, "http://a.net/x")]
    pages = spark.createDataFrame([(*r, "h", 0.5, True, 1, "r") for r in rows], "page_id long, url string, host string, rate double, blocked boolean, n int, rule string")
    outcomes = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "page_id long, bad int")
    got = url_filter.judge(pages, outcomes).collect()
    assert len(got) == 6 and sum(r.page_id is None for r in got) == 2
    assert {r.host for r in got} == {"a.net", "", "b.net"} and len({r.host_rate for r in got if r.host == "a.net"}) == 1 and all(r.host_rate is None for r in got if r.host != "a.net")


def test_beta_quantile():
    a, b = np.array([1.0, 1.0, 3.0, 0.5]), np.array([1.0, 4.0, 1.0, 0.5])
    want = [0.05, 1 - 0.95**0.25, 0.05 ** (1 / 3), np.sin(np.pi * 0.05 / 2) ** 2]
    assert np.allclose(url_filter.beta_quantile(a, b, 0.05), want, atol=1e-9)


def test_licenses(spark, odd, nothing):
    rows = [(1, "foo bar\nReleased under the MIT License.\nbaz"), (2, "This work is licensed under the GNU General Public License, version 3. Other words"), (3, "my driving licence expired long ago and nobody noticed it at all"), (4, None)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license, got[1].confirmed, got[1].start, got[1].end, got[1].missing) == ("MIT-short", True, 8, 39, []) and got[2].license == "GPL-3.0" and got[2].confirmed
    assert not got[3].confirmed and 4 not in got
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(nothing).count() == 0


def test_wrapped_licenses():
    """Notices of several lines (comments too) or sentences, in other text, in long lines, and a template without a cue."""
    import textwrap

    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name in ("Apache-2.0", "MIT", "ISC", "GPL-3.0-notice", "BSD-3-Clause"):
        notice = license_scan.TEMPLATES[name]
        for width, mark in ((70, ""), (78, "# "), (60, " * "), (40, "// ")):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(notice, width))
            text = f"import this\n\n{wrapped}\n\ndef f(): pass\nand more of it"
            got = scanner.scan(text)
            assert [(f["license"], f["confirmed"]) for f in got if f["confirmed"]] == [(name, True)], (name, width, got)
            f = next(f for f in got if f["confirmed"])
            assert text[f["start"] : f["end"]].strip("\n") == wrapped
        long = "Some other words stand here. " * 100 + notice + " And so it goes on. " * 40
        assert [f["license"] for f in scanner.scan(long) if f["confirmed"]] == [name]
    bare = license_scan.Scanner({"beer": "As long as you retain this notice you can do whatever you want with this stuff"})
    assert [f["confirmed"] for f in bare.scan("x y\nAs long as you retain this notice\nyou can do whatever you want with this stuff\nz")] == [True]


def test_verdicts_do_not_hang_on_line_breaks():
    import textwrap

    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    share_alike = "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."
    cases = [("MIT-full", license_scan.TEMPLATES["MIT-full"]), ("CC-BY-SA-4.0-long", share_alike), ("CC-BY-SA-4.0-view", license_scan.TEMPLATES["CC-BY-SA-4.0-view"]), ("CC-BY-NC-SA-4.0-long", license_scan.TEMPLATES["CC-BY-NC-SA-4.0-long"])]
    for name, notice in cases:
        for text in (notice, "\n".join(textwrap.wrap(notice, 76)), "\n".join("# " + x for x in textwrap.wrap(notice, 40)), "words before it and " + notice.rstrip(".") + " and words after it, all in one sentence"):
            got = [f["license"] for f in scanner.scan(text) if f["confirmed"]]
            assert name in got, (name, text[:200], scanner.scan(text))
    grant = license_scan.TEMPLATES["MIT"].rstrip(".") + ", and to permit persons to whom the Software is furnished to do so"
    one, wrapped = ([(f["license"], f["confirmed"]) for f in scanner.scan(x)] for x in (grant, "\n".join(textwrap.wrap(grant, 76))))
    assert ("MIT", True) in one and ("MIT", True) in wrapped


def test_licenses_against_all_windows():
    """Edited notices among other words: whenever some window of words is near enough to a template, one that overlaps it is confirmed."""
    import difflib

    names = ["MIT-short", "GPL-3.0", "CC-BY-4.0-long", "Unlicense", "BSD-3-Clause"]
    scanner = license_scan.Scanner({k: license_scan.TEMPLATES[k] for k in names})
    rng = random.Random(6)
    found = 0
    for case in range(60):
        words = license_scan.TEMPLATES[names[case % len(names)]].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choices(["other", "the", "words"], k=rng.randrange(2))
        filler = lambda: rng.choices(["lorem", "ipsum", "under", "the", "work.", "license;", "of\n"], k=rng.randrange(9))
        text = " ".join([*filler(), *words, *filler()])
        all_words = license_scan.WORD.findall(text.lower())
        near = False
        for own in scanner.words.values():
            for i in range(len(all_words)):
                for j in range(i + 1, min(len(all_words), i + int(len(own) / 0.75) + 1) + 1):
                    ops = difflib.SequenceMatcher(None, own, all_words[i:j], autojunk=False).get_opcodes()
                    n = sum((o[2] - o[1]) + (o[4] - o[3]) for o in ops if o[0] != "equal")
                    near |= n <= 0.25 * max(len(own), j - i)
        got = any(f["confirmed"] for f in scanner.scan(text)) if scanner.has_cue(text) else False
        assert got or not near, text
        found += got
    assert found >= 30


def test_found_licenses_on_odd_rows(spark):
    """Nulls, repeats, ties between templates and clashing columns around a notice that is there."""
    notice = "Released under the MIT License."
    rows = [(1, notice, 5), (1, notice, 5), (None, notice, 5), (2, None, 5), (3, "", 5), (4, notice + "\n" + notice, 5), (5, "x " * 40000 + notice, 5)]
    got = license_scan.scan(spark.createDataFrame([(*r, "s", 1, "l") for r in rows], "doc_id long, text string, block int, license string, start int, saved string"))
    by = collections.Counter((r.doc_id, r.license, r.confirmed) for r in got.collect())
    assert by == {(1, "MIT-short", True): 2, (None, "MIT-short", True): 1, (4, "MIT-short", True): 2, (5, "MIT-short", True): 1}
    tie = license_scan.Scanner({"b": notice, "a": notice})
    assert [f["license"] for f in tie.scan(notice)] == ["a"]  # of equal templates the first by name


def counts(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice, covered = collections.Counter(three), set()
    for i, g in enumerate(three):
        if twice[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, texts, odd, nothing):
    def rows(d):
        return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) for r in quality_rules.judge(d).collect()]

    for d, c, failed, kept in rows(docs):
        assert c == counts(texts[d]) and failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and kept == (not failed)
    assert sorted(c for _, c, _, _ in rows(odd)) == sorted(counts(t) for _, t, _ in ODD)
    assert quality_rules.judge(nothing).count() == 0


def test_bad_host_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 2 or i > 550 else "#", "bad" if i <= 600 and i % 2 == 0 else "good") for i in range(600)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.kept for r in got if r.doc_id > 560 and r.doc_id % 2 == 0} == {False} and all(r.kept for r in got if r.doc_id % 2)


def test_passages(spark, docs, texts, odd, nothing):
    where = collections.defaultdict(set)
    for d, t in texts.items():
        w = t.encode().lower().split()
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(d)
    got = {r.doc_id: r for r in passage_dedup.passages(docs).collect()}
    assert len(got) == len(texts)
    for group in where.values():
        assert len({got[d].class_id for d in group}) == 1 and (len(group) == 1 or all(got[d].repeated for d in group))
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(70)]
    near = [*shared[:35], "changed", *shared[36:]]
    rows = [(i, " ".join([*[word() for _ in range(100)], *part, *[word() for _ in range(80)]])) for i, part in enumerate([shared, near, shared[:38], []])]
    small = {r.doc_id: r for r in passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [small[i].class_id for i in range(4)] == [0, 0, 2, 3] and [small[i].repeated for i in range(4)] == [True, True, False, False]
    span = small[0].spans[0]
    assert span.start <= 102 and span.start + span.words >= 168
    assert passage_dedup.passages(odd).count() == len(ODD) and passage_dedup.passages(nothing).count() == 0


def test_equal_passages_behind_a_frequent_phrase(spark):
    """Two texts share 50 words, whose first 44 stand in 30 others too: these are similar to neither."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], []
    for _ in range(20):
        phrase, rest = some(44), some(6)
        pairs.append((len(rows), len(rows) + 1))
        rows += [" ".join([*some(60), *phrase, *(rest if i < 2 else some(6)), *some(40)]) for i in range(32)]
    got = {r.doc_id: r for r in passage_dedup.passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[a].class_id == got[b].class_id and got[a].repeated and got[b].repeated for a, b in pairs] == [True] * len(pairs)
    assert sum(r.repeated for r in got.values()) == 2 * len(pairs)


def brute_links(texts):
    """Pairs of texts with similar passages, by the sets of all their windows."""
    width = passage_dedup.WIDTH
    words = [t.split() for t in texts]
    wins = [[frozenset(map(tuple, (w[i : i + 5] for i in range(s, s + width)))) for s in range(len(w) - 4 - width + 1)] for w in words]
    whole = [frozenset().union(*w) for w in wins]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(whole[i] & whole[j]) >= passage_dedup.COMMON]
    return [(i, j) for i, j in near if any(len(a & b) >= 0.8 * len(a | b) for a in wins[i] for b in wins[j])]


@pytest.mark.parametrize("few, many", [(24, 20_000), (4, 20_000), (1, 8)])  # pair by pair, by common keys, by keys through a shuffle
def test_near_passages_against_brute_force(spark, few, many):
    """A group of variants that are mostly unlike one another, and pairs with one word changed, put in or left out."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = some(60), []
    for _ in range(60):
        part = list(base)
        for _ in range(2):
            part[rng.randrange(60)] = some(1)[0]
        texts.append(" ".join([*some(40), *part, *some(40)]))
    for i in range(60):
        part = some(52 + i % 9)
        other, at = list(part), rng.randrange(5, len(part) - 5)
        other[at : at + (i % 3 != 1)] = [[f"x{i}"], [f"x{i}"], []][i % 3]
        texts += [" ".join([*some(30), *part, *some(30)]), " ".join([*some(33), *other, *some(30)])]
    links = brute_links(texts)
    parent = list(range(len(texts)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r for r in passage_dedup.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), few=few, many=many).collect()}
    same = [got[a].class_id == got[b].class_id for a, b in links]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if find(a) == find(b)]
    assert len(links) > 150 and sum(same) >= 0.95 * len(same) and sum(got[a].class_id == got[b].class_id for a, b in pairs) >= 0.9 * len(pairs)
    linked = {v for pair in links for v in pair}
    assert not [d for d, r in got.items() if r.repeated and d not in linked]


def test_passages_of_odd_rows(odd, nothing):
    """Nulls, empty texts, repeated rows and columns with clashing names, column by column."""
    got = sorted(((r.doc_id, r.class_id, r.repeated, r.n_repeat_words) for r in passage_dedup.passages(odd).collect()), key=str)
    want = [(d, d, False, 0) for d, _, _ in ODD if d not in (7, 8)] + [(7, 7, True, 9000), (8, 7, True, 9001)]
    assert [(*g[:3],) for g in got] == [(*w[:3],) for w in sorted(want, key=str)]
    assert {g[0]: g[3] for g in got if g[2]} == {7: 9000, 8: 9000}
    assert passage_dedup.passages(nothing).count() == 0


def test_similarity_at_every_start():
    """A word put in, or left out, at any place of a passage in unrelated text: all starts against sets built anew."""
    rng, width, side = np.random.default_rng(6), passage_dedup.WIDTH, passage_dedup.SIDE
    word = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 10**6, n))
    found = 0
    for trial in range(60):
        shared = word(54 + trial % 7).split()
        cut = 15 + trial % 25
        other = shared[:cut] + (["extra"] if trial % 2 else []) + shared[cut + 1 - trial % 2 :]
        x, y = (passage_dedup.shingles([" ".join([word(70), *p, word(70)]).encode()])[0].astype(np.uint32) for p in (shared, other))
        at = 70 + (4 if cut > 25 else 46)  # the anchor, before the change or after it
        by = 0 if cut > 25 else len(other) - len(shared)
        rows = [(0, n, a, a - side, z[a - side : a + side + 1].view(np.uint8).reshape(-1, 4)[:, :3].tobytes()) for n, a, z in ((0, at, x), (1, at + by, y))]
        got = np.flatnonzero(passage_dedup.similar(passage_dedup.Laid(rows), np.array([0]), np.array([1]))[0])
        x, y = x & np.uint32(0xFFFFFF), y & np.uint32(0xFFFFFF)
        sets = [(set(x[s : s + width].tolist()), set(y[s + by : s + by + width].tolist())) for s in range(at - side, at + 1)]
        want = [s for s, (a, b) in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]
        assert got.tolist() == want
        found += bool(want)
    assert found >= 40
    again = np.tile(np.arange(5), 30)[None]  # repeated shingles count once
    assert passage_dedup.distinct(again, 46)[0].tolist() == [5] * (again.size - 45)


def test_compact_windows():
    """The minima are the nodes of the Cartesian tree that hold a passage, each with the starts of its compact window."""
    h, width = np.random.default_rng(2).integers(0, 1 << 62, 3000).astype(np.uint64), 46
    want, todo = np.empty(len(h) - width + 1, np.int64), [(0, len(h))]
    while todo:
        left, right = todo.pop()
        if right - left >= width:
            c = left + int(h[left:right].argmin())
            want[max(left, c - width + 1) : min(c, right - width) + 1] = c
            todo += [(left, c), (c + 1, right)]
    assert (passage_dedup.minima(h, width) == want).all()


def test_shingles_do_not_hang_on_their_neighbours(monkeypatch):
    texts = [b"", b"a b c d", b"A b\tc d  e f", b"\n", b"x y z a b c d e f", "é b c d e".encode()]
    alone = [passage_dedup.shingles([t])[0].tolist() for t in texts]
    for size in (1 << 20, 3):
        monkeypatch.setattr(passage_dedup, "SLICE", size)
        x, n = passage_dedup.shingles(texts)
        assert n.tolist() == [0, 0, 2, 0, 5, 1] and x.tolist() == sum(alone, []) and alone[2] == alone[4][-2:]


def test_marginals_against_all_taggings():
    rng, n = np.random.default_rng(0), 6
    model = toxicity.Model({}, transition=tuple(rng.normal(size=4)))
    u = rng.normal(size=n) * 2
    total, ones, t = 0.0, np.zeros(n), np.array(model.transition).reshape(2, 2)
    for y in np.ndindex(*[2] * n):
        w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        total, ones = total + w, ones + w * np.array(y)
    assert np.allclose(model.marginals(list(u)), ones / total)


def test_logistic_curve_settles():
    """Overlapping, separable and lopsided classes: the curve rises, and no other slope or offset nearby has less loss."""
    rng = np.random.default_rng(4)
    for gap, n1 in ((0.5, 300), (8.0, 300), (40.0, 20), (20.0, 5)):
        x, y = np.r_[rng.normal(-gap, 1, 2000), rng.normal(0, 1, n1)], np.r_[np.zeros(2000), np.ones(n1)]
        w = np.r_[np.full(2000, 1.1), np.full(n1, 0.4)]
        slope, offset = toxicity.fit_logistic(x, y, w)
        assert slope > 0
        c = np.average(x, weights=w)

        def loss(s, o):
            z = s * x + o
            b = o + s * c
            return w @ (np.logaddexp(0, z) - y * z) + len(x) / 200 * (0.02 * s * s + 1e-6 * b * b)

        assert all(loss(slope, offset) <= loss(slope + ds, offset + do) for ds in (-0.01, 0, 0.01) for do in (-0.01, 0, 0.01))


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(7)
    bad, word = ["grumble", "vexfoo", "vexbar"], lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, truth int")


def test_toxicity(spark, toxic_docs, odd, nothing):
    labels = toxic_docs.selectExpr("doc_id", "truth as toxic")
    model = toxicity.fit(toxic_docs.drop("truth"), labels)
    got = {r.doc_id: r for r in toxicity.score(toxic_docs, model).collect()}
    truth = {r.doc_id: r.truth for r in toxic_docs.collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and got[d].predicted == truth[d] == int(got[d].score >= 0.3) for d in truth)
    r = next(got[d] for d in truth if truth[d])
    text = {x.doc_id: x.text for x in toxic_docs.collect()}[r.doc_id]
    assert {text[s.start : s.end] for s in r.spans} <= {"grumble", "vexfoo", "vexbar"} and r.spans
    scores = [x.score for x in toxicity.score(odd, model).collect()]
    assert len(scores) == len(ODD) and max(scores) < 0.3 and toxicity.score(nothing, model).count() == 0
    assert toxicity.reject(toxic_docs, model).count() == 300
    assert {x.predicted for x in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0}


def test_toxicity_does_not_hang_on_the_order_of_rows(spark, toxic_docs):
    labels = toxic_docs.selectExpr("doc_id", "truth as toxic")
    a, b = (toxicity.fit(toxic_docs.repartition(n).drop("truth"), labels.repartition(m)) for n, m in ((1, 3), (5, 2)))
    assert a.weights == b.weights and a.context == b.context and abs(a.offset - b.offset) < 1e-9


def test_neighbours_count():
    """The same word is tagged beside one word and not beside another."""
    rng, telling = random.Random(2), ["drop"]
    words = [f"w{i}" for i in range(30)]
    segments = []
    for i in range(300):
        line = rng.choices(words, k=10)
        line[4:6] = ["you", "drop"] if i % 2 else ["the", "drop"]
        segments.append((line, [5] if i % 2 else [], [1.0] if i % 2 else []))
    model = toxicity.fit_field(segments, telling, 100)
    assert len(model.tag("w1 w2 you drop w3")[1]) == 1 and not model.tag("w1 w2 the drop w3")[1]


def test_toxicity_from_few_labels(spark, docs, toxic_docs):
    """Few toxic rows still give a model: words seen in four of them, in no clean one; and never an empty one."""
    labels = table(spark, SMALL, "labels")
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, model).collect() if truth.get(r.doc_id) is not None]
    caught = [r.predicted for r in rows if truth[r.doc_id] == 1]
    wrong = [r.predicted for r in rows if truth[r.doc_id] == 0]
    assert model.weights and sum(caught) >= 0.5 * len(caught) and sum(wrong) <= 0.05 * len(wrong)
    assert toxicity.reject(docs, model).count() < docs.count()
    few = toxic_docs.filter("doc_id < 9").selectExpr("doc_id", "truth as toxic")
    assert toxicity.fit(toxic_docs.drop("truth"), few).weights


def test_mixing(spark, docs, odd, nothing):
    labels = table(spark, SMALL, "labels")
    model = mixing.fit_classifier(docs, labels)
    targets = {"high": 0.8, "low": 0.15, "toxic": 0.05}
    rows = mixing.mix(docs, model, targets).toPandas()
    p, n = rows[["p_high", "p_low", "p_toxic"]].to_numpy(), rows.tokens.to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rows.rate >= 0).all() and ((rows.copies - rows.rate).abs() < 1).all()
    assert np.allclose((n * rows.rate) @ p / n.sum(), [0.8, 0.15, 0.05], atol=0.02)
    # The same problem, all at once in memory: projected gradient steps until they settle.
    w, r = n / n.sum(), np.ones(len(n))
    for _ in range(4000):
        r = np.maximum(0, r - (p @ (p.T @ (w * r) - [0.8, 0.15, 0.05]) + 1e-3 * (r - 1)))
    assert np.abs((w * r) @ p - (w * rows.rate.to_numpy()) @ p).max() < 0.01
    assert mixing.mix(odd, model, targets).count() == len(ODD) and mixing.mix(nothing, model, targets).count() == 0
    more = mixing.remix(docs, model, {"high": 0.9, "low": 0.1})
    assert more.columns == docs.columns and more.select("doc_id").distinct().count() == docs.count()
    assert mixing.remix(nothing, model, targets).count() == 0


@pytest.mark.parametrize("share", [0.003, 0.001, 0.0003])
def test_mixing_meets_the_target_of_a_rare_domain(spark, share):
    rng, n = np.random.default_rng(3), 20_000
    kind = np.where(np.arange(n) < share * n, 2, np.where(np.arange(n) % 5 == 0, 1, 0))
    p = 0.99998 * np.eye(3)[kind] + 0.00002 / 3
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(rng.integers(50, 500, n), p)], "tokens long, p array<double>")
    for floor in (0.0, 1.0):
        _, report = mixing.fit_rates(members, {"high": 0.90, "low": 0.07, "toxic": 0.03}, floor)
        goal, after = report["goal"], report["after"]
        assert all(abs(after[d] - goal[d]) < 0.001 * report["total"] for d in goal)
        assert abs(after["toxic"] / sum(after.values()) - 0.03) < 0.001


@pytest.mark.parametrize("share", [0.1, 0.3])
def test_mixing_pushes_a_common_domain_down(spark, share):
    """Reachable targets are met as by least squares without any other term, whose minimum is zero here; and nothing warns."""
    rng, n = np.random.default_rng(5), 6000
    kind = np.where(np.arange(n) < share * n, 2, np.where(np.arange(n) % 9 == 0, 1, 0))
    p = rng.dirichlet([0.3, 0.3, 0.3], n) * 0.3 + 0.7 * np.eye(3)[kind]
    tokens = rng.integers(50, 500, n)
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p)], "tokens long, p array<double>")
    targets = {"high": 0.75, "low": 0.18, "toxic": 0.07}
    w, r, lead = tokens / tokens.sum(), np.ones(n), np.ones(n)
    for i in range(20000):  # the same least squares in memory, with momentum
        new = np.maximum(0, lead - p @ ((w * lead) @ p - list(targets.values())))
        lead, r = new + i / (i + 3) * (new - r), new
    assert np.abs((w * r) @ p - list(targets.values())).max() < 1e-4
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="mixing")
        steps, report = mixing.fit_rates(members, targets)
    assert max(map(abs, report["missed"].values())) < 1e-5 and report["passes"] <= 20
    assert np.abs((w * steps.rate(p)) @ p - (w * r) @ p).max() < 1e-4


def test_mixing_says_what_is_out_of_reach(spark):
    p = [[0.5, 0.3, 0.2]] * 50 + [[0.6, 0.2, 0.2]] * 50
    members = spark.createDataFrame([(10, q) for q in p], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="out of reach"):
        steps, report = mixing.fit_rates(members, {"high": 0.9, "low": 0.1})
    w, r = np.full(100, 0.01), np.ones(100)
    for _ in range(5000):
        r = np.maximum(0, r - np.array(p) @ ((w * r) @ np.array(p) - [0.9, 0.1, 0]))
    least = np.linalg.norm((w * r) @ np.array(p) - [0.9, 0.1, 0])
    assert np.linalg.norm([*report["missed"].values()]) <= 1.02 * least


def test_sharding(docs, texts, odd, nothing):
    def check(rows, law_bytes):
        shards = collections.defaultdict(list)
        for r in rows:
            shards[r.shard].append(r)
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        for part in shards.values():
            assert sorted(r.slot for r in part) == list(range(len(part)))
        if law_bytes:
            sizes = [sum(r.size for r in shards[i]) for i in range(16)]
            assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)

    rows = sharding.shard_by_bytes(docs).collect()
    check(rows, True)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    some = sharding.shard_by_bytes(odd).collect()
    check(some, False)
    assert len(some) == len(ODD) and sharding.shard_by_bytes(nothing).count() == 0


def bare(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_exact(odd, nothing, chunk):
    got = exact_dedup.duplicates(odd, chunk=chunk).collect()
    groups = collections.defaultdict(list)
    for d, t, _ in ODD:
        groups[bare(t)].append((-len(t or ""), d is None, d))
    for r in got:
        t = next(b for b in groups if hashlib.sha256(b.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == min(groups[t], key=lambda g: (g[0], g[1], g[2] or 0))[2] and r.group_size == len(groups[t])
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len(groups)
    assert exact_dedup.duplicates(nothing).count() == 0
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_collisions_are_told_apart(odd, monkeypatch):
    """With a fingerprint that is the same for all texts of a length, comparison still keeps different texts apart."""
    monkeypatch.setattr(exact_dedup, "PRIMES", (1, 1))
    monkeypatch.setattr(exact_dedup, "BASES", (1, 1))
    assert sum(r.kept for r in exact_dedup.duplicates(odd).collect()) == len({bare(t) for _, t, _ in ODD})


def test_fingerprints_compose():
    data, base, prime = bytes(range(256)) * 700, exact_dedup.BASES[0], exact_dedup.PRIMES[0]
    whole = exact_dedup.polynomial(data, base, prime)
    for cut in (1, 1000, 70_000):
        tail = exact_dedup.polynomial(data[cut:], base, prime) * int(exact_dedup.power(base, np.array([cut]), prime)[0])
        assert (exact_dedup.polynomial(data[:cut], base, prime) + tail) % prime == whole == sum((b + 1) * pow(base, i, prime) for i, b in enumerate(data)) % prime


def test_simhash(spark, odd, nothing):
    assert simhash.simhash(b"") == 0 and simhash.simhash(b"A b") == simhash.simhash(b" a\tB ")
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noise = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in (0, 1, 2, 3, 4, 5)]
    fps = np.array([*noise, *rng.integers(0, 1 << 63, 300, dtype=np.uint64)], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while (new := np.where(near, label[None, :], len(fps)).min(axis=1)).tolist() != label.tolist():
        label = new
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for limit in (40_000, 2):  # the second sends every list through the grouped path
        roots = {r.node: r.root for r in connected_components(simhash.near_pairs(rows, limit)).collect()}
        got = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
        same = np.array(got)[:, None] == np.array(got)[None, :]
        assert (same == (label[:, None] == label[None, :])).all()
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16} and {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in out})


def test_passages_do_not_hang_on_the_number_of_runs(spark):
    """The same classes and spans whether a signature's runs share an array, have one of their own, or go through a shuffle."""
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = some(58), []
    for i in range(40):
        part = list(base)
        for _ in range(1 + i % 3):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(2)] = some(rng.randrange(2))
        texts.append(" ".join([*some(20), *part, *some(20), *(part if i % 9 == 0 else [])]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [sorted((r.doc_id, r.class_id, r.n_repeat_words, tuple(r.spans or [])) for r in passage_dedup.passages(docs, few=few, many=many).collect()) for few, many in ((24, 20_000), (1, 20_000), (1, 4))]
    assert got[0] == got[1] == got[2] and any(n for _, _, n, _ in got[0])


def test_keys_are_shared_by_all_similar_passages():
    """A key in common if and only if 41 of 46 shingles are, against sets: words changed, put in, left out, parts that changed places."""
    rng, width, side = np.random.default_rng(7), passage_dedup.WIDTH, passage_dedup.SIDE
    word = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    found = 0
    for trial in range(150):
        p, cut, kind = word(58), int(rng.integers(0, 54)), trial % 6
        gap, put = [(1, 1), (0, 1), (1, 0), (0, 2), (2, 2), (0, 0)][kind]
        q = [*p[:cut], *word(put), *p[cut + gap :]]
        if kind == 5:
            cut = 25 + trial % 9
            q = [*p[cut:50], *p[:cut], *word(8)]
        windows = []
        for node, words in ((0, p), (1, q)):
            x = passage_dedup.shingles([" ".join([*words, *word(2 * side)]).encode()])[0].astype(np.uint32)[: 2 * side + 1] & np.uint32(0xFFFFFF)
            windows.append((x, (5, node, side | side << 32 | (side - 9) << 38, 0, x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())))
        laid = passage_dedup.Laid([w[1] for w in windows])
        keys = [{}, {}]
        for t, (key, row, col) in enumerate(passage_dedup.common_keys(laid)):
            for k, r, c in zip(key.tolist(), row.tolist(), col.tolist()):
                keys[r].setdefault(c, set()).add((t, k))
        for c in keys[0]:
            for d in keys[1]:
                common = len(set(windows[0][0][c : c + width].tolist()) & set(windows[1][0][d : d + width].tolist()))
                assert bool(keys[0][c] & keys[1][d]) == (common >= passage_dedup.COMMON), (trial, c, d, common)
                found += common >= passage_dedup.COMMON
    assert found > 100


def test_comparison_leaves_out_only_idle_keys():
    """A comparison tells the same passages and links as all keys would, and makes a small part of them."""
    rng, side = np.random.default_rng(9), passage_dedup.SIDE
    word = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    rows, node = [], 0
    for group in range(40):
        base = word(2 * side + 5)
        for member in range(2 + group % 5 * (group % 3)):
            part = list(base)
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(20, 120))
                part[at : at + int(rng.integers(0, 2))] = word(int(rng.integers(0, 2)))
            x = passage_dedup.shingles([" ".join([*part, *word(2)]).encode()])[0].astype(np.uint32)[: 2 * side + 1] & np.uint32(0xFFFFFF)
            rows.append((group, node, side | side << 32, 0, x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()))
            node += member != 3  # two runs of one text
        node += group % 4 > 0  # a text that is in two signatures
    laid = passage_dedup.Laid(rows)
    hit, links = set(), []
    for key, row, col in passage_dedup.common_keys(laid):
        at = collections.defaultdict(list)
        for k, r, c in zip(key.tolist(), row.tolist(), col.tolist()):
            at[k].append((r, c))
        for places in at.values():
            if len(nodes := {int(laid.node[r]) for r, _ in places}) > 1:
                hit |= set(places)
                links += [(min(nodes), n) for n in nodes if n != min(nodes)]
    told = set()
    joined = []
    for b in passage_dedup.compare(laid):
        for _, a, o, s, e in zip(*(c.to_pylist() for c in b.columns)):
            told |= {(a, p) for p in range(s, e + 1)}
            joined += [(a, o)] * (a != o)
    assert told == {(int(laid.node[r]), c) for r, c in hit} and len(told) > 500
    roots = lambda pairs: sorted(zip(*(v.tolist() for v in passage_dedup.forest(*map(np.array, zip(*pairs))))))
    assert roots(joined) == roots(links)
    every = sum(len(key) for key, _, _ in passage_dedup.common_keys(laid))
    total = passage_dedup.met(laid)
    assert sum(len(key) for key, _, _ in passage_dedup.common_keys(laid, total, passage_dedup.Told(laid))) < every / 1.2
    passages = [(r, c) for _, row, col in passage_dedup.common_keys(laid, total) for r, c in zip(row.tolist(), col.tolist())]
    assert hit <= set(passages)
