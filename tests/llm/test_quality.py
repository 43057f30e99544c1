import random
import re

from lodequery.llm import quality, queries

TEXTS = [
    None, "", " \t\n", "one", "w " * 9, "a b c d e f g h i j", "x y z " * 40, "line one\nline one\nline two\n\n\n \n \nline one", "a b c d e a b c d e f a b c d e",
    "#$% *** word|word <b>", "nbsp joined words é ü", "\x1cone\x1dtwo", "one two three four five six seven eight nine ten eleven\r\nline\r\nline\r\n", "word " * 20_000, "x" * 100_000,
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 10 or 100 * rep > 20 * n


def test_measures_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.with_measures(docs).collect():
        q = r["__quality"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == plain(TEXTS[r.doc_id]), repr(TEXTS[r.doc_id])[:50]


def clean(i):
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(1, 60)) + "."


def test_verdicts_and_extra_columns(spark):
    rows = [(i, clean(i), "x") for i in range(60)] + [(100 + i, " ".join(f"{w}*** |" for w in clean(i).split()), None) for i in range(8)] + [(None, None, None), (None, clean(3), "y"), (3, clean(3), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = quality.good(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in got) == sorted([(False, i, "x") for i in range(60)] + [(True, 0, "y"), (False, 3, "x")])


def test_posteriors_trust_rare_bad_votes():
    all_good = sum(2 * 3**k for k in range(len(quality.RULES)))
    two_bad = all_good - 2 - 2 * 3
    p = quality.posteriors({all_good: 900, two_bad: 50})
    assert p[all_good] > 0.9 and p[two_bad] < 0.5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.fit(quality.with_measures(docs)) == {} and quality.good(docs).count() == 0


def votes(text):
    """Each rule's vote by its own plain measure: 0 bad, 1 abstains, 2 good."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    _, chars, symbols, dup, rep, _ = plain(text)
    n = len(words)
    letters = [c for c in text if re.match(r"[^\W\d_]", c)]
    shares = {
        "symbols": symbols / n, "repeats": rep / n, "echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "dup_lines": dup / max(1, len(lines)),
        "capitals": sum(bool(re.match("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]", c)) for c in letters) / max(1, len(letters)), "shouts": sum(c in "!?" for c in text) / n,
        "non_letters": 1 - sum(bool(re.match(r"[^\W_]", c)) for c in text) / max(1, chars), "long_words": sum(len(w.encode()) > 30 for w in words) / n,
        "bare": sum(not re.search(r"[^\W_]", w) for w in words) / n, "near_echoes": sum(words[i] in words[i - 3 : i] for i in range(3, n)) / n,
    }
    return {k: 0 if shares[k] >= bad else 2 if shares[k] <= good else 1 for k, (good, bad) in quality.RULES.items()}


def test_query_against_brute_force(spark, tmp_path):
    """The registered query's verdicts are those of expectation-maximisation over documents, one at a time, rule by rule."""
    rng = random.Random(4)
    rows = [(i, clean(i) + "\n" + clean(i + 7)) for i in range(150)]
    for i in range(150, 230):
        words = clean(i).split()
        for _ in range(rng.randrange(0, 40)):
            k = rng.randrange(len(words))
            words[k] = rng.choice(["###", "WHAT!!!", "$$$", words[k - 1], "x" * 40, "---", "LOUD", words[k] + "*"])
        rows.append((i, " ".join(words)))
    rows += [(900 + k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality_rules"](spark, str(tmp_path)).collect()}
    asked = {i: votes(t) for i, t in rows if not plain(t)[5]}
    bad_share = quality.START_BAD
    rate = {c: {r: list(quality.START[c]) for r in quality.RULES} for c in ("good", "bad")}
    for _ in range(quality.ROUNDS):
        p = {}
        for i, vs in asked.items():
            odds = {"good": 1 - bad_share, "bad": bad_share}
            for c in odds:
                for r, v in vs.items():
                    if v != 1:
                        odds[c] *= rate[c][r][v] / (rate[c][r][0] + rate[c][r][2])
            p[i] = odds["good"] / (odds["good"] + odds["bad"])
        bad_share = min(0.5, max(1e-6, (sum(1 - x for x in p.values()) + quality.START_BAD) / (len(p) + 1)))
        for c in rate:
            for r in quality.RULES:
                mass = list(quality.START[c])
                for i, vs in asked.items():
                    mass[vs[r]] += p[i] if c == "good" else 1 - p[i]
                rate[c][r] = [m / sum(mass) for m in mass]
    assert len(got) == len(rows) and 0 < sum(x < 0.5 for x in p.values()) < len(p) / 2
    for i, _ in rows:
        if i in p:
            assert abs(got[i].p_good - p[i]) < 1e-9 and got[i].kept == (p[i] >= 0.5), i
        else:
            assert got[i].p_good is None and not got[i].kept
