import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lexmill.llm import urlfilter as u


def test_viterbi_is_the_best_split():
    r = random.Random(3)
    s = u.Segmenter({"a": 5, "ab": 9, "abc": 2, "bc": 4, "ca": 7, "cab": 1})
    for _ in range(60):
        name = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))

        def cost(words):
            return sum(s.cost.get(w, s.unseen[len(w)]) for w in words)

        best = math.inf
        for cut in product((0, 1), repeat=len(name) - 1):
            words, at = [], 0
            for i, c in enumerate(cut, 1):
                if c:
                    words.append(name[at:i])
                    at = i
            best = min(best, cost([*words, name[at:]]))
        found = s.split(name)
        assert "".join(found) == name and cost(found) == pytest.approx(best)


@pytest.mark.parametrize(
    "url, wanted",
    [("https://User@WWW.Cheap-Pills.example.com:80/en/1?x=y#z", ("www.cheap-pills.example.com", "/en/1", "x=y")), ("//h/p", ("h", "/p", "")), ("nothing", None), ("", None), (None, None), ("http:///x", None)],
)
def test_split_url(url, wanted):
    assert u.split_url(url) == wanted


def pages(spark, rows):
    return spark.createDataFrame([(i, x, f"<p>{h}</p>", "k") for i, (x, h) in enumerate(rows)], "page_id bigint, url string, html string, host string")


def test_learns_and_equals_brute_force(spark):
    good = [(f"http://garden{i % 7}.example.org/tools/{i}", "garden tools and seeds") for i in range(60)]
    bad = [(f"http://luckycasino{i % 5}.example.org/winnow/{i}", "lucky") for i in range(20)]
    rows = pages(spark, good + bad + [("http://x.example.org/winnow", ""), (None, None), ("", ""), ("nohost", None)])
    model = u.train(rows)
    out = u.filter_urls(rows, model).orderBy("page_id").collect()
    assert [r.blocked for r in out[:80]] == [False] * 60 + [True] * 20
    assert out[60]["host_words"] == ["lucky", "casino", "example"]
    assert all(r["host"] == "k" for r in out)
    assert [(r["host_"], r["spam_score"], r["blocked"]) for r in out[81:]] == [(None, None, False)] * 3
    for r in out[:81]:
        host, words, path = model.words(r.url)
        plain = model.prior + sum(model.odds.get("h:" + w, model.unseen) for w in words) + sum(model.odds.get("p:" + w, 0.0) for w in path)
        assert r["spam_score"] == pytest.approx(plain)
    # 20 of 81 pages with a host are examples; "winnow" stands in all of them and in one other.
    assert model.prior == pytest.approx(math.log(21 / 62))
    assert model.odds["p:winnow"] > 0 > model.odds["p:tools"]


def plain_bayes(urls, model, known=None, smoothing=0.5):
    """Odds of all words by counting them in loops; hosts are split by the model."""
    seen = {}
    pages = [0, 0]
    for k, url in enumerate(urls):
        found = model.words(url)
        if found is None or (known is not None and known[k] is None):
            continue
        tagged = [f"h:{w}" for w in found[1]] + [f"p:{w}" for w in found[2]]
        bad = any(w[2:] in u.SEEDS for w in tagged) if known is None else known[k]
        pages[not bad] += 1
        for w in tagged:
            seen.setdefault(w, [0, 0])[not bad] += 1
    out = {}
    for kind in "hp":
        mine = {w: n for w, n in seen.items() if w[0] == kind}
        totals = [sum(n[i] + smoothing for n in mine.values()) for i in (0, 1)]
        out |= {w: math.log((n[0] + smoothing) / totals[0]) - math.log((n[1] + smoothing) / totals[1]) for w, n in mine.items()}
    return math.log((pages[0] + 1) / (pages[1] + 1)), out


def test_counts_against_loops(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/pages.parquet")
    model = u.train(rows)
    prior, odds = plain_bayes([r.url for r in rows.select("url").collect()], model)
    assert model.prior == pytest.approx(prior) and model.odds == pytest.approx(odds)


def made_up(seed, n):
    """URLs of which unwanted ones hold words of their own, and one in two of these a seed too."""
    r = random.Random(seed)
    good, bad = ["garden", "tools", "river", "school", "library", "recipe", "travel", "music"], ["lucky", "bonus", "jackpots", "spin", "winner", "vegas"]
    rows = []
    for i in range(n):
        wrong = r.random() < 0.3
        words = [r.choice(bad if wrong and r.random() < 0.8 else good) for _ in range(3)]
        seeded = wrong and r.random() < 0.5
        host = "".join(words[:2]) + ("casino" if seeded else "")
        rows.append((f"http://{host}.example.org/{words[2]}/{i}", " ".join(good + bad + ["casino"]), wrong, seeded))
    return rows


def test_held_out_pages_without_a_seed_word(spark):
    schema = "url string, html string, wrong boolean, seeded boolean"
    rows, other = spark.createDataFrame(made_up(1, 1500), schema), spark.createDataFrame(made_up(2, 600), schema)
    right = lambda label: [(r.blocked == r.wrong) for r in u.filter_urls(other, u.train(rows, label=label)).where("NOT seeded").collect()]
    assert sum(right("wrong")) / len(right("wrong")) > 0.9
    assert sum(right(None)) / len(right(None)) > 0.85  # seeds alone as labels
    half = rows.withColumn("some", F.when(F.length("url") % 2 == 0, F.col("wrong")))
    model = u.train(half, label="some")
    prior, odds = plain_bayes([r.url for r in half.collect()], model, [r.some for r in half.collect()])
    assert model.prior == pytest.approx(prior) and model.odds == pytest.approx(odds)


def test_tables_score_like_a_model_that_is_sent(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/pages.parquet").select("url", "html", F.lit("k").alias("scored"), F.lit("q").alias("blocked"))
    odd = spark.createDataFrame([(None, None, "k", "q"), ("", "", "k", "q"), ("nohost", "x", "k", "q"), ("http://www.com/", "", "k", "q"), ("http://" + "luckycasino" * 400 + ".org/" + "a/" * 5000, "", "k", "q"), ("http://luckycasino.org/a", "", "k", "q"), ("http://luckycasino.org/a", "", "k", "q")], rows.schema)
    rows = rows.unionByName(odd)
    small, large = u.train(rows), u.train(rows, limit=0)
    assert isinstance(small, u.UrlModel) and isinstance(large, u.UrlTables)
    key = lambda r: repr((r.url, r.host, r.host_words, r.blocked_, None if r.spam_score is None else round(r.spam_score, 6)))
    a, b = (sorted(map(key, u.filter_urls(rows, m).collect())) for m in (small, large))
    assert a == b and len(a) == rows.count()
    assert u.filter_urls(rows.where("url = 'no'"), large).count() == 0


def test_rare_words_keep_their_odds(spark):
    """60,000 common path words leave no word out, be it of hosts or of the dictionary."""
    names = ["qz" + "".join("bcdfghjklmnprstv"[i >> k & 15] for k in (12, 8, 4, 0)) for i in range(60_000)]
    good = [(f"http://garden.example.org/{'/'.join(names[i : i + 100] * 2)}", "") for i in range(0, len(names), 100)]
    rows = pages(spark, [*good, ("http://warez.example.org/", "zumba zumba tango tango")])
    model = u.train(rows)
    assert sum(w.startswith("p:qz") for w in model.odds) == 60_000
    assert model.odds["h:warez"] > 0
    assert model.segmenter.split("zumbatango") == ("zumba", "tango")
    assert [r.url for r in u.filter_urls(rows, model).where("blocked").collect()] == ["http://warez.example.org/"]


def test_words_of_hosts_split_like_all_words(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/pages.parquet")
    whole, part = u.train(rows), u.train(rows, urls=rows)
    assert len(part.segmenter.cost) < len(whole.segmenter.cost)
    assert part.odds == pytest.approx(whole.odds) and part.segmenter.unseen == whole.segmenter.unseen
    assert all(part.words(r.url) == whole.words(r.url) for r in rows.select("url").collect())


def test_empty(spark):
    none = pages(spark, [])
    assert u.filter_urls(none, u.train(none)).count() == 0


def test_known_bad_hosts(spark, tiny):
    out = u.query(spark, tiny).collect()
    bad = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x")
    assert all(r.blocked == any(b in r.url for b in bad) for r in out)
