"""SimHash, components, decontamination, HTML, M-tree, quality, licenses and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillrank.llm import components, decontaminate, html_template, licenses, mtree, quality_rules, simhash
from quillrank.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def union_find(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# ---- components


@pytest.mark.parametrize("shape", ["path", "star", "random", "ring"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 200
    links = {
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(77, i) for i in range(n)],
        "ring": [(i, (i + 1) % 50) for i in range(50)] + [(i, i + 1) for i in range(60, 70)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(110)],
    }[shape]
    want = union_find(n, links)
    df = spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == linked
    groups = {}
    for x in linked:
        groups.setdefault(got[x], set()).add(want[x])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[x] for x in linked})
    local = components.local_roots(n, *np.array(links).T)
    assert local.tolist() == want


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op6


def plain_simhash(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ("A b C d", "Ä Ö ü x", "", None, "one two", "a a a a a a b", "w " * 70_000 + "end", "x" * 200_000):
        assert simhash.simhash64(t) == plain_simhash(t)


def brute_components(rows, fps):
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = union_find(len(rows), links)
    least = {}
    for (k, _), r in zip(rows, roots, strict=True):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, f"{f:016x}", least.get(r)) for (k, _), f, r in zip(rows, fps, roots, strict=True)), key=str)


def test_simhash_query(spark, tmp_path):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = base[k % 12].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, base[0]), (503, base[0]), (3, base[3])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in simhash.op6_simhash_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_components(rows, [plain_simhash(t) for _, t in rows])


def assert_links(spark, fps, radius, bucket):
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius=radius, bucket=bucket).collect()
    at = {s: i for i, s in enumerate(signed)}
    got = union_find(len(fps), [(at[a], at[b]) for a, b in edges])
    x = np.array(fps, np.uint64)
    links = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius)]
    assert got == union_find(len(fps), links)
    assert len(links) > 20


@pytest.mark.parametrize(("bucket", "radius"), [(512, 2), (2, 2), (3, 1), (4, 3)])
def test_near_links_lose_none(spark, bucket, radius):
    rng = random.Random(bucket)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(8):
            y = rng.choice([x, *fps]) if rng.random() < 0.5 else x
            for _ in range(rng.randrange(radius + 2)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    assert_links(spark, sorted(fps), radius, bucket)


def test_near_links_in_a_crowded_bucket(spark):
    """Three thousand fingerprints share 40 bits, and so the heads of several chains: they pass both rings and the blocks."""
    rng = random.Random(2)
    base = rng.getrandbits(40)
    assert_links(spark, sorted({base | rng.getrandbits(10) << rng.choice((40, 46, 54)) | rng.getrandbits(2) << 62 for _ in range(3000)}), 2, 64)


@pytest.mark.parametrize(("radius", "segments"), [(1, 2), (2, 7), (2, 5), (3, 7), (19, 20)])
def test_pigeonring(radius, segments):
    """Every pair within the radius has a good chain, and its head is equal."""
    rng = random.Random(segments)
    parts, first = simhash.ring(segments, list(range(64))), simhash.heads(radius, segments, list(range(64)))
    assert sum(parts) == 2**64 - 1 and len(first) == segments
    for _ in range(300):
        xor = sum(1 << k for k in rng.sample(range(64), rng.randrange(radius + 1)))
        ok = [i for i in range(segments) if simhash.chain_ok(np.array([xor], np.uint64), np.array([i]), radius, parts)[0]]
        assert ok and all(xor & first[i] == 0 for i in ok)


def edited(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicate_stage(spark):
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(4000)]
    clean = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 300))) for _ in range(150)]
    rows = list(enumerate(clean))
    long = [t for t in clean if len(t.split()) > 100][:40]
    rows += [(1000 + k, edited(rng, t, 0.01)) for k, t in enumerate(long)]
    rows += [(2000, clean[0]), (2001, clean[0].upper().replace(" ", "  ")), (None, clean[1]), (2002, None), (2003, "")]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [(3000 + k, f"{' '.join(rng.choice(vocab) for _ in range(120))} {passage}") for k in range(20)]
    df = frame(spark, rows).withColumn("rep", F.lit(1))
    out = simhash.stage(spark, df, "")
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns
    assert set(range(150)) <= set(kept) and set(range(3000, 3020)) <= set(kept)
    assert None in kept and len({2002, 2003} & set(kept)) == 1
    assert not {2000, 2001} & set(kept)
    assert len(set(range(1000, 1040)) & set(kept)) <= 1
    assert simhash.stage(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("window", [1, 3, 2048])
def test_near_duplicates_under_common_seeds(spark, window):
    """However small the window and however cut the runs, kept texts that share a seed are apart and groups leave one."""
    rng = random.Random(11)
    vocab = ["word" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    base = [[rng.choice(vocab) for _ in range(300)] for _ in range(5)]
    rows = []
    for i in range(150):
        words = list(base[i % 5])
        if i >= 5:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    # the same words in another order share each seed and no shingle
    shuffled = [rng.sample(base[0], len(base[0])) for _ in range(40)]
    rows += [(1000 + i, " ".join(w)) for i, w in enumerate(shuffled)]
    gone = {r.doc_id for r in simhash.near_duplicates(frame(spark, rows).repartition(7), window=window).collect()}
    assert {i for i, _ in rows} - gone == set(range(5)) | set(range(1000, 1040))


def test_near_duplicates_of_block_edits_and_appended_text(spark):
    """Kept texts are below 0.8 of common five-word shingles, whatever the edit; a group leaves its smallest id."""
    rng = random.Random(5)
    vocab = ["word" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    rows, near = [], set()

    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    for i in range(120):
        words = [rng.choice(vocab) for _ in range((200, 600)[i % 2])]
        more = [rng.choice(vocab) for _ in range(int(len(words) * rng.uniform(0.05, 0.28)))]
        at = rng.randrange(len(words) - len(more))
        copy = words + more if i % 3 else words[:at] + more[: len(more) // 2] + words[at + len(more) // 2 :]
        a, b = shingles(words), shingles(copy)
        if len(a & b) >= 0.8 * len(a | b):
            near.add(1000 + i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    gone = {r.doc_id for r in simhash.near_duplicates(frame(spark, rows).repartition(5)).collect()}
    assert 40 < len(near) < 120 and gone == near


def test_near_duplicates_by_the_pigeonring(spark, monkeypatch):
    """Copies with a SimHash fingerprint within 2 bits go by it alone: no first shingle is shared, and the prefixes never see them."""
    rng = random.Random(13)
    vocab = ["word" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    word = lambda h: np.frombuffer(simhash.wide_majority(h), np.uint64)[0]
    rows, copies = [], set()
    while len(copies) < 6:
        i = len(copies)
        base = [rng.choice(vocab) for _ in range(1500)]
        copy = base + [rng.choice(vocab) for _ in range(8)]
        while not (a := simhash.shingle_set(" ".join(base), 5))[0] > (b := simhash.shingle_set(" ".join(copy), 5))[0]:
            copy[-8:] = [rng.choice(vocab) for _ in range(8)]
        if 0 < np.bitwise_count(word(a) ^ word(b)) <= 2:
            rows += [(i, " ".join(base)), (1000 + i, " ".join(copy))]
            copies.add(1000 + i)
    seen, rare_first = set(), simhash.rare_first

    def watched(keyed, *args):
        seen.update(r.rep for r in keyed.select("rep").distinct().collect())
        return rare_first(keyed, *args)

    monkeypatch.setattr(simhash, "rare_first", watched)
    gone = {r.doc_id for r in simhash.near_duplicates(frame(spark, rows).repartition(5)).collect()}
    assert gone == copies and seen == set(range(6))


def test_ring_groups(spark):
    """Rows that a 64-bit word of their fingerprints links are grouped, equal words included; rows without such a word are left out."""
    rng = random.Random(17)
    prints = [[rng.getrandbits(64) for _ in range(simhash.WIDE)] for _ in range(60)]
    for k in range(60):
        of, fp = prints[rng.randrange(len(prints))], [rng.getrandbits(64) for _ in range(simhash.WIDE)]
        lane = k % simhash.WIDE
        fp[lane] = of[lane]
        for b in rng.sample(range(64), k % 4):
            fp[lane] ^= 1 << b
        prints.append(fp)
    near = [(i, j) for i in range(120) for j in range(i) if any((a ^ b).bit_count() <= 2 for a, b in zip(prints[i], prints[j], strict=True))]
    df = spark.createDataFrame([(i, np.array(fp, np.uint64).tobytes()) for i, fp in enumerate(prints)], "rep long, fp binary")
    groups = {}
    for r in simhash.ring_groups(df).collect():
        groups.setdefault(r.key, []).append(r.rep)
    assert len(near) > 40 and {i for g in groups.values() for i in g} == {i for pair in near for i in pair}
    assert union_find(120, [(g[0], i) for g in groups.values() for i in g]) == union_find(120, near)


def test_common_shingles_come_last(spark, monkeypatch):
    """Texts that share a passage meet by rare shingles; no link is lost, also if only some of the common ones are moved."""
    rng = random.Random(8)
    vocab = ["word" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(90):
        own = [rng.choice(vocab) for _ in range(120)]
        rows += [(i, " ".join(own + passage)), (1000 + i, " ".join(own[:-3] + passage + ["more", "words"]))]
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    first = [(int(k), i) for i, h in sets.items() for k in h[: simhash.prefix_length(len(h), 0.8)].view(np.int64)]
    of = spark.createDataFrame([(i, h.tobytes()) for i, h in sets.items()], "rep long, set binary")
    keyed, counts = simhash.rare_first(spark.createDataFrame(first, "key long, rep long"), lambda met: of.join(met, "rep", "left_semi"), 0.8, 8, simhash.HOT)
    got = [(r.key, r.rep) for r in keyed.collect()]
    assert max(Counter(k for k, _ in first).values()) > 100 and max(Counter(k for k, _ in got).values()) <= 8
    assert {r.k: r.n for r in counts.collect()} == {k: n for k, n in Counter(k for k, _ in got).items() if n > 1}
    assert Counter(i for _, i in got) == Counter(i for _, i in first)
    pairs = {(a, b) for a in sets for b in sets if a < b and simhash.similar(sets[a], sets[b], 0.8)}
    mine = {i: {k for k, j in got if j == i} for i in sets}
    assert len(pairs) >= 90 and all(mine[a] & mine[b] for a, b in pairs)
    monkeypatch.setattr(simhash, "HOT", 20)
    gone = {r.doc_id for r in simhash.near_duplicates(frame(spark, rows).repartition(5), window=8).collect()}
    assert gone == {b for _, b in pairs}


def test_cells_meet_every_pair(spark):
    """Links of a key of many blocks connect what brute force connects."""
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (6, simhash.WIDE), dtype=np.uint64)
    prints = []
    for i in range(60):
        fp = centres[i % 6].copy()
        for b in rng.integers(0, 512, 30).tolist():
            fp[b // 64] ^= np.uint64(1 << b % 64)
        prints.append(fp)
    rows = [(7 if i < 50 else 8, i, fp.tobytes()) for i, fp in enumerate(prints)]
    df = spark.createDataFrame(rows, "key long, rep long, fp binary")
    got = [(r.a, r.b) for r in simhash.cell_links(df, 88, 4).collect()]
    near = [(i, j) for i in range(60) for j in range(i) if rows[i][0] == rows[j][0] and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 88]
    assert union_find(60, got) == union_find(60, near)


# ---- op7


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(2)
    items = decontaminate.Items()
    codes = decontaminate.Codes()
    for k in range(60):
        items.add(k, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(3, 40))), codes)
    items.close()
    for _ in range(300):
        fp = int(items.prints[rng.randrange(60)])
        for _ in range(rng.randrange(26)):
            fp ^= 1 << rng.randrange(64)
        want = {k for k in range(60) if (int(items.prints[k]) ^ fp).bit_count() <= decontaminate.RADIUS}
        assert set(items.within(fp).tolist()) == want


def brute_leaks(docs, bench):
    out = set()
    for d, t in docs:
        words = decontaminate.tokens(t)
        for i, b in bench:
            item = decontaminate.tokens(b)
            if d is None or not item or len(words) < 1:
                continue
            n = min(5, len(item))
            grams = lambda ws: Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))  # noqa: B023, E731
            want = grams(item)
            for at in range(max(1, len(words) - len(item) + 1)):
                if decontaminate.weighted_similarity(grams(words[at : at + len(item)]), want) >= 0.8:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("per_pass", [1000, 3])
def test_contaminated(spark, per_pass):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(500)}"
    bench = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 4, 5, 8, 30, 40, 40, 60])] + [(90, None), (91, ""), (None, "x y z"), (92, "the same the same the same the same the same the same")]
    docs = [(k, " ".join(word() for _ in range(80))) for k in range(40)]
    for k, (_, b) in enumerate(bench[4:9]):
        w = b.split()
        docs.append((100 + k, f"{word()} {word()} {b.upper().replace(' ', ', ')}. {word()}"))
        if len(w) > 20:
            docs.append((200 + k, " ".join([word(), *w[:-1], word(), word()])))
            docs.append((300 + k, " ".join(w[: len(w) // 2])))
        docs.append((400 + k, b))
    docs += [(500, None), (501, ""), (None, bench[6][1]), (502, bench[6][1] * 1 + " z " * 50_000), (503, bench[12][1])]
    df = frame(spark, docs).withColumn("item_id", F.lit("clash"))
    got = decontaminate.contaminated(df, spark.createDataFrame([*bench, bench[6]], "item_id long, text string"), per_pass).collect()
    want = brute_leaks([d for d in docs if d[0] != 502], bench) | {(502, 6)}
    assert {(r["doc_id"], r["item_id"]) for r in got} - {(502, i) for i in range(4)} == want - {(502, i) for i in range(4)}
    assert all(r["similarity"] >= 0.8 and r["end_word"] > r["start_word"] for r in got)


def test_edits_within_the_similarity_stay_within_the_radius():
    """Items of 8 to 300 words, edited down to a similarity of 0.8: each is found, and the fingerprints differ in up to nearly all of the radius."""
    rng, codes, most, close = random.Random(12), decontaminate.Codes(), 0, 0
    for _ in range(400):
        words = [f"u{rng.randrange(4000)}" for _ in range(rng.choice((8, 12, 30, 80, 300)))]
        items = decontaminate.Items()
        items.add(1, " ".join(words), codes)
        items.close()
        text = list(words)
        for k in rng.sample(range(len(words)), 1 + len(words) // 60):
            text[k if rng.random() < 0.5 else rng.choice((0, 1, -1, -2))] = "other"
        grams = lambda ws: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        similarity = decontaminate.weighted_similarity(grams(text), grams(words))
        found = decontaminate.scan(" ".join(["before", "it", *text, "and", "after"]), items, codes)
        if similarity >= 0.8:
            assert found and found[0][0] >= similarity
            most, close = max(most, found[0][3]), close + (similarity < 0.9)
        assert not found or found[0][0] >= 0.8
    assert close > 50 and 10 <= most <= decontaminate.RADIUS


def test_decontamination_stage(spark, sf_dir):
    bench = [r["text"] for r in table(spark, sf_dir, "benchmark").limit(3).collect()]
    df = frame(spark, [(1, f"Some words. {bench[0]} And more."), (2, "a clean text of a few words"), (None, bench[1]), (3, None)])
    assert {r["doc_id"] for r in decontaminate.stage(spark, df, sf_dir).collect()} == {2, None, 3}


# ---- op2

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &lt;%d&gt;</h1><p>One <b>bo</b>ld<br>line %d<p>Two &eacute;&nbsp;x<form><input value=">">Name</form><div class="ad">Buy</div>
<aside>Side</aside><div id="comments"><p>Nice!</p></div><table><tr><td>c1<td>c2</table></article>
<!-- <p>hidden</p> --><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(k, f"http://h{k % 2}.example.com/{k}", PAGE % (k, k)) for k in range(6)]
    rows += [(10, None, None), (11, "x", ""), (12, "http://one.org", "<p>just text &am; 1 < 2</p>"), (13, "http://h0.example.com/x", "<article>open"), (0, "http://h0.example.com/0", PAGE % (0, 0))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = html_template.extract_main_text(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert text[3] == "Head <3> One bold line 3 Two é x c1 c2"
    assert (text[10], text[11], text[12], text[13]) == ("", "", "just text &am; 1 < 2", "open")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_template.extract_main_text(df.limit(0)).count() == 0


def test_template_of_a_host_without_article(spark):
    page = "<body><div class='top'>Welcome to our site</div><div><p>Body text number %d is here</p></div><div>Call us now</div></body>"
    df = spark.createDataFrame([(k, "http://s.org/", page % k) for k in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in html_template.extract_main_text(df).collect()} == {f"Body text number {k} is here" for k in range(5)}


def alone(page):
    """A page's text by its own template."""
    parsed = html_template.parse(page)
    blocks = parsed.blocks()
    main, drop = html_template.choose(html_template.slots_of(parsed, blocks))
    under = lambda role, top: role == top or role.startswith(top + "/")
    return " ".join(t for r, t, _ in blocks if under(r, main) and not any(under(r, d) for d in drop))


def test_the_template_decides(spark):
    """Pages without telling tags or class names: a long banner that repeats, texts from a pool, and a short article."""
    page = "<body><div>A long banner says the same on each page of this host, whatever the page is about</div><div><div><h2>Head {0}</h2>Article {0} {1}</div><div>Offer of the week: {2}</div></div></body>"
    rows = [(k, "http://t.org/", page.format(k, "word " * (k + 4), ("shoes and boots", "hats")[k % 2])) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(df).collect()}
    assert got == {k: f"Head {k} Article {k} {'word ' * (k + 4)}".strip() for k in range(8)}
    assert all(alone(h) != got[k] for k, _, h in rows)  # without the host's template the banner is taken for text


def test_a_page_without_its_hosts_main_slot(spark):
    rows = [(k, "http://a.org/", f"<body><article><p>Text {k} of some length</p></article></body>") for k in range(4)] + [(9, "http://a.org/x", "<body><div>Another layout</div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(df).collect()}
    assert got == {k: f"Text {k} of some length" for k in range(4)} | {9: "Another layout"}


def test_template_text_within_an_article(spark):
    page = "<body><nav>Menu</nav><article><h1>Head %d</h1><div class='x7'>Read <a>all</a> our offers</div><p>Text number %d</p><p>Same</p><p class='by'>By <b>author %d</b></p></article></body>"
    rows = [(k, "http://a.org/", page % (k, k, k)) for k in range(5)] + [(k, "http://b.org/", page % (1, 1, 1)) for k in range(10, 14)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(df).collect()}
    assert {k: got[k] for k in range(5)} == {k: f"Head {k} Text number {k} Same By author {k}" for k in range(5)}
    assert {got[k] for k in range(10, 14)} == {"Head 1 Read all our offers Text number 1 Same By author 1"}  # copies alone show no template


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>one two</p></article><div class="sidebar">x</div></div>', "one two"),
        ('<div id="page" class="no-ads"><main><p>text</p></main></div>', "text"),
        ("<article><header><h1>Title</h1><nav>menu</nav></header><p>body</p><footer>by</footer></article>", "Title body"),
        ('<article><div class="social-science">about it</div><p>body</p><div class="social-share">tell</div></article>', "about it body"),
        ('<div><h1>T</h1><p>The post</p></div><section id="comments"><article><p>a reader says so</p></article></section>', "T The post"),
        ('<div><h1>T</h1><p>The post</p></div><article class="comment">a reader says so</article>', "T The post"),
        ('<form id="f"><nav>x</nav><div class="content"><h1>T</h1><p>The post</p></div><form>q</form></form>', "T The post"),
        ('<article><p>a</p><form>search <input></form><aside>more</aside><p>b <span class="ad">buy</span>c</p></article>', "a b c"),
        ('<html class="no-ads"><body class="has-sidebar"><article><p>Text &eacute;</p><div class="sidebar">x</div></article></body></html>', "Text \u00e9"),
        ("<article>" + "<p>word word" * 20_000 + "<i>" * 500, " ".join(["word word"] * 20_000)),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p>a</p><div class='w-1/2 " + "long " * 500 + "'>b</div></article>", "a b"),
    ],
)
def test_marks_and_shapes(page, text):
    assert alone(page) == text


def test_pages_table(spark, sf_dir):
    import html

    got = {r["page_id"]: r["text"] for r in html_template.op2_html_extract(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "")).split())
        assert got[r["page_id"]] == want


# ---- op4


def brute_top(rows, k=5, every=50):
    ok = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out, best = [], {}
    for q, a in ok:
        for i, b in ok if q % every == 0 else ():
            if i != q and len(a) == len(b):
                s = sum(x * y for x, y in zip(a, b, strict=True))
                best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, s))
    for q, scores in best.items():
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def test_top_k(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(160)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(100, [0.5, 0.5, 0.5, 0.5]), (7, rows[7][1]), (0, rows[0][1])]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4), (302, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (450, []), (-50, [1e6, -1e6, 3e5, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("c"))
    monkeypatch.setattr(mtree, "PER_LEAF", 16)
    monkeypatch.setattr(mtree, "PAGE", 8)
    got = sorted(tuple(r) for r in mtree.m_tree_top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)
    assert mtree.m_tree_top_k(df.limit(0)).count() == 0


def test_top_k_visits_few_leaves_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=8) * 0.05]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("PER_LEAF", 12), ("PAGE", 16)):
        monkeypatch.setattr(mtree, name, value)
    seen = []
    keep = mtree.materialize
    monkeypatch.setattr(mtree, "materialize", lambda df, tag, *a, **k: seen.append((tag, out := keep(df, tag, *a, **k))) or out)
    assert sorted(tuple(r) for r in mtree.m_tree_top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows)
    visits = [sum(len(r["qids"]) // 8 for r in out.collect()) for tag, out in seen if tag == "visits"]
    assert len(visits) > 2 and sum(visits) < 0.7 * 24 * 100  # of 24 queries and 100 leaves


def test_scores_beyond_64_bits_are_errors():
    big = np.array([[2**40, 2**40]], np.int64)
    with pytest.raises(OverflowError):
        mtree.exact_scores(big, big)
    other = np.array([[2**40, -(2**40)]], np.int64)
    assert mtree.exact_scores(big, other).tolist() == [[0]]  # the parts are beyond 64 bits, the score isn't
    assert mtree.exact_scores(np.array([[2**30, 3]]), np.array([[2**29, 5]])).tolist() == [[2**59 + 15]]


def test_components_that_cannot_be_quantized_are_errors(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\*\\*53"):
        mtree.m_tree_top_k(df).collect()


def test_top_k_of_more_lengths_than_a_thousand(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(50 * i + j, [float(x) for x in rng.integers(-3, 4, size=i)]) for i in range(1, 1101) for j in (0, 0, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(mtree, "TREES", 0, raising=False)
    got = sorted(tuple(r) for r in mtree.m_tree_top_k(df, k=2).select("query_id", "rank", "vec_id", "score").collect())
    vecs = {}
    for i, v in rows:
        vecs.setdefault((len(v), i), []).append(np.floor(256 * np.array(v)).astype(np.int64))
    want = []
    for d in range(1, 1101):
        best = {j: max(int(a @ b) for a in vecs[d, 50 * d] for b in vecs[d, 50 * d + j]) for j in (1, 2)}
        want += [(50 * d, n + 1, 50 * d + j, best[j]) for n, j in enumerate(sorted(best, key=lambda j: (-best[j], j)))]
    assert got == sorted(want)


# ---- op8


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    scored = quality_rules.op8_quality_classifier(spark, big)
    rows = scored.join(table(spark, big, "labels").select(F.col("doc_id").alias("i"), "quality"), F.col("doc_id") == F.col("i")).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "!" * 300_000), (None, "words"), (4, "plain words here"), (4, "plain words here")]
    df = frame(spark, rows).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r["_score"], 6) for r in quality_rules.score_quality(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 4, 5)] + [(4, None, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.score_quality(df, labels)
    assert out.count() == len(rows) and out.where("_score is null").count() == 0
    assert quality_rules.score_quality(df.limit(0), labels).count() == 0


def test_compiled_rules_equal_the_fitted_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    rules, b = quality_rules.fit_rules(x, y)
    z = b + sum(r.weight * r.fires(x) for r in rules)
    assert np.mean((z > 0) == (y == 1)) > 0.98
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = [r[0] for r in df.select(quality_rules.compile_score(rules, b, ["a", "b", "c"])).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


# ---- op10


def test_patience_alignment():
    a, b = "x the quick brown fox jumps over the dog y".split(), "the quick red fox leaps over the dog".split()
    got = licenses.align(a, b)
    assert [a[i] for i, _ in got] == ["the", "quick", "fox", "over", "the", "dog"]
    assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got))
    assert licenses.align([], b) == [] and licenses.rising([]) == []
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(15))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_rising_is_a_longest_rising_run():
    rng = random.Random(4)
    for _ in range(200):
        pairs = list(enumerate(rng.sample(range(12), rng.randrange(12))))
        got = licenses.rising(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False)) and set(got) <= set(pairs)
        longest = [1] * len(pairs)
        for k in range(len(pairs)):
            longest[k] = 1 + max((longest[i] for i in range(k) if pairs[i][1] < pairs[k][1]), default=0)
        assert len(got) == max(longest, default=0)


def common_run(a, b):
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_places_against_all_windows():
    """Random texts with an edited template somewhere: what is found is what some window of all holds."""
    rng = random.Random(7)
    template = [f"t{k}" for k in range(12)]
    known = licenses.Templates({"L": [" ".join(template)]})
    hits = 0
    for _ in range(150):
        place = [w for w in template if rng.random() > rng.choice((0, 0.1, 0.25))]
        for _ in range(rng.randrange(4)):
            place.insert(rng.randrange(len(place) + 1), f"n{rng.randrange(9)}")
        words = [f"n{rng.randrange(9)}" for _ in range(8)] + place + [f"n{rng.randrange(9)}" for _ in range(8)]
        found = licenses.scan(" ".join(words), known)
        windows = ((i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
        want = any((n := common_run(words[i:j], template)) >= 0.8 * 12 and n >= 0.8 * (j - i) for i, j in windows)
        assert bool(found) == want
        hits += want
        for _, coverage, first, last, _ in found:
            assert common_run(words[first:last], template) == round(coverage * 12)
    assert 40 < hits < 140


def test_whole_license_texts():
    known = licenses.Templates(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            got = licenses.scan(f"The beginning.\n{text}\nThe end.", known)
            assert [(g[0], g[1]) for g in got] == [(name, 1.0)], name
    whole = licenses.TEMPLATES["MIT"][3].split()
    edited = " ".join(w for k, w in enumerate(whole) if k % 9)
    assert [g[0] for g in licenses.scan(edited, known)] == ["MIT"]


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = licenses.TEMPLATES["MIT"][2]
    rows = [(1, f"Text.\n{apache}\nMore text, under the sun."), (2, f"{apache} {apache}"), (3, None), (4, ""), (5, "under the license of the state, version 2"), (6, "Licensed under CC BY-NC 4.0."), (7, "licensed UNDER cc by 4.0")]
    rows += [(8, "w " * 50_000 + mit.replace("hereby ", "").replace("\n", " ")), (None, apache), (9, "This work is licensed under the GNU General Public License, version 3"), (9, "word")]
    out = licenses.scan_licenses(frame(spark, rows).withColumn("license", F.lit("c"))).collect()
    got = Counter((r["doc_id"], r["license"]) for r in out)
    assert got == Counter({(1, "Apache-2.0"): 1, (2, "Apache-2.0"): 2, (6, "CC-BY-NC-4.0"): 1, (7, "CC-BY-4.0"): 1, (8, "MIT"): 1, (None, "Apache-2.0"): 1, (9, "GPL-3.0"): 1})
    assert next(r for r in out if r["doc_id"] == 1)["excerpt"] == apache[:-1]
    assert all(licenses.COVERAGE <= r["coverage"] <= 1 for r in out)
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0


VERBATIM = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,""",
}


def test_verbatim_licenses():
    known = licenses.Templates(licenses.TEMPLATES)
    for name, text in VERBATIM.items():
        got = licenses.scan(f"The software of the license.\n{text}\nThe copy of the software.", known)
        assert [g[0] for g in got] == [name]
        assert got[0][1] == 1 and got[0][4].split()[0] == text.split()[0]
        twice = licenses.scan(f"{text} {text}", known)
        assert [g[0] for g in twice] == [name] * 2 and twice[0][3] <= twice[1][2]
    together = licenses.scan("\n".join(VERBATIM.values()), known)
    assert [g[0] for g in together] == list(VERBATIM)


def test_edited_licenses_are_found_wherever_the_edits_are():
    rng, known = random.Random(1), licenses.Templates({"MIT": [licenses.TEMPLATES["MIT"][2]]})
    words = licenses.TOKEN.findall(licenses.TEMPLATES["MIT"][2].lower())
    for _ in range(100):
        gone = set(rng.sample(range(len(words)), 4))
        text = [w for k, w in enumerate(words) if k not in gone]
        for _ in range(3):
            text.insert(rng.randrange(1, len(text)), rng.choice(["x", "y", "z"]))
        assert [g[0] for g in licenses.scan(" ".join(["of the software", *text, "to deal in the software"]), known)] == ["MIT"]


# ---- the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    big = sf_dir.replace("0.001", "0.01")
    docs = table(spark, big, "documents")
    ids, columns = None, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, big)
        assert out.columns == columns
        rows = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert rows and (ids is None or rows <= ids), name
        ids, docs = rows, spark.createDataFrame(out.collect(), out.schema)
    out = corpus_pipeline.run(spark, big)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= ids
    benchmark = {r["text"] for r in table(spark, big, "benchmark").collect()}
    assert not [1 for r in out.select("text").collect() if any(b in r["text"] for b in benchmark)]


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage on its own input over all documents of the smallest tables, by plain Python."""
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    labels, bench = table(spark, sf_dir, "labels"), [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    text_of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)

    rules, intercept = quality_rules.learn(docs, labels)
    wide, names = quality_rules.with_statistics(docs)
    rows = wide.select("doc_id", *names).toPandas()
    x = rows[names].to_numpy(float)
    good = intercept + sum(r.weight * r.fires(x) for r in rules) >= 0
    one = keep(stages["quality_classifier"](spark, docs, sf_dir))
    assert set(text_of(one)) == set(rows.doc_id[good].tolist()) and 0 < good.sum() < len(rows)

    two = keep(stages["line_dedup"](spark, one, sf_dir))
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in text_of(one).items():
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    stays = lambda i, line: len(key(line)) < 10 or min(holders[key(line)]) == i
    assert text_of(two) == {i: t if t is None else "\n".join(x for x in t.split("\n") if stays(i, x)) for i, t in text_of(one).items()}

    three = keep(stages["simhash_near_dedup"](spark, two, sf_dir))
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in text_of(two).items()}
    alike = lambda i, j: (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) >= 0.8
    left, gone = set(text_of(three)), set(sets) - set(text_of(three))
    assert gone and not [(i, j) for i in left for j in left if i < j and alike(i, j)]
    assert all(any(alike(i, j) for j in sets if j < i) for i in gone)

    four = keep(stages["benchmark_decontamination"](spark, three, sf_dir))
    leaks = {d for d, _ in brute_leaks(list(text_of(three).items()), bench)}
    assert set(text_of(four)) == left - leaks

    last = corpus_pipeline.run(spark, sf_dir).collect()
    counts = Counter(r["doc_id"] for r in last)
    by_source, share = {}, {}
    for r in four.collect():
        by_source[r["source"]] = by_source.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    ordered = sorted(by_source, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ordered)}
    rest, open_ = 1.5 * sum(by_source.values()), set(ordered)
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * by_source[s]}
        share |= {s: 2.0 * by_source[s] if s in full else weights[s] * level for s in full or open_}
        rest -= sum(share[s] for s in full)
        open_ = open_ - full if full else set()
    for r in four.collect():
        rate = share[r["source"]] / by_source[r["source"]] if by_source[r["source"]] else 0.0
        drawn = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert counts[r["doc_id"]] == int(rate) + (drawn < rate - int(rate))
    assert set(counts) <= set(text_of(four))
