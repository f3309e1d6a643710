import re
import zlib

import pytest
from pyspark.sql import functions as F

from roadspeed.llm import url_filter as U

URLS = [None, "", "no scheme/x", "http://A.Example.ORG/es/1?x=/en/", "https://example.org/en/12#f", "http://org/a", "http://borg/a",
        "ftp://x.com/fr/", "http://x.com/FR/", "http://com/de/", "http://x.com?q=/de/", "a://b.com/de/://c", "http://É.com/fr/é",
        "http://sub.example.org/en/2", "://example.org", "http://xexample.org/es/", "http://a\nb.org/x", "http://" + "long/" * 3000]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


@pytest.fixture(scope="module")
def model(spark):
    return U.fit(U.labelled_urls(spark))


def test_rules_match_brute_force(spark, model):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").selectExpr("*", "1 as x", "'p' as host")
    got = [tuple(r) for r in U.url_filter(df, model).collect()]
    assert len(got) == len(URLS) + 1
    for i, host, path, rule, verdict, score in got:
        want = brute(URLS[i])
        assert (host, path, rule) == want[:3] and 0 <= score <= 1
        assert verdict == (want[3] or ("block" if score > 0.5 else "allow"))


def test_held_out_accuracy(spark):
    rows = U.labelled_rows()
    right = 0
    for fold in range(2):
        own = [zlib.crc32(u.encode()) % 2 == fold for u, _ in rows]
        model = U.fit(spark.createDataFrame([r for r, x in zip(rows, own) if x], "url string, label double"))
        held = spark.createDataFrame([(i, r[0]) for i, (r, x) in enumerate(zip(rows, own)) if not x], "page_id long, url string")
        got = U.url_filter(held, model, rules=[]).collect()
        right += sum((r.verdict == "block") == (rows[r.page_id][1] == 1.0) for r in got)
    assert right >= 0.9 * len(rows)


def test_empty_table(spark, model):
    assert U.url_filter(spark.createDataFrame([], "page_id long, url string"), model).collect() == []


@pytest.mark.parametrize("text", ["", "a", "ab", "abc.example", "x" * 5000, "é😀.com"])
def test_grams_are_all_runs(spark, text):
    for size in U.SIZES:
        row = spark.createDataFrame([(text,)], "t string").select(U._grams(F.col("t"), "h", size).alias("g")).first()
        full = f"^{text}$"
        assert row.g == ["h" + full[i:i + size] for i in range(len(full) - size + 1)]


# Hosts that are no word of the lists alone, and none of the table's forms.
UNSEEN = [(1.0, h) for h in """bestcasinobonus.io online-slots24.net pokerstarsfan.org xxxvideos.tv adultdating.club
hotgirlscams.live cheapviagra.shop genericpills.biz buybacklinks.pro paydayloansnow.us lotterywinner.co replicawatches.store
adserver3.network trackclicks.media freejackpot.win crackkeygen.download torrentz.to spamlinks.info""".split()] + [
    (0.0, h) for h in """springfieldlibrary.info uni-physics.edu nationalmuseum.dk citycouncil.gov childrenshospital.care
dailynews.today sciencejournal.press mountainhiking.guide birdwatching.club gardenrecipes.kitchen chessforum.net
weatherstation.earth poemsandletters.page oldbooks.store softwaredocs.dev farmersmarket.local harbourmaps.sea
artpainting.gallery""".split()]


def test_unseen_hosts(spark, model):
    df = spark.createDataFrame([(k, f"https://{h}/en/{k}") for k, (_, h) in enumerate(UNSEEN)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in U.url_filter(df, model, rules=[]).collect()}
    right = sum(got[k] == (label == 1.0) for k, (label, _) in enumerate(UNSEEN))
    print("unseen hosts", right, "of", len(UNSEEN), [h for k, (l, h) in enumerate(UNSEEN) if got[k] != (l == 1.0)])
    assert right >= 0.85 * len(UNSEEN)
    assert sum(got[k] for k, (label, _) in enumerate(UNSEEN) if label == 0.0) <= 1
