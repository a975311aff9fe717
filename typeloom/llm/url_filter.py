"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model reads the host and the path only. It is fitted on a small labelled table of
URLs (TRAINING below, a parameter of the operator) by full-batch gradient descent in
plain Python on the driver; its weights are one fixed-size array. Judging is a
projection of built-in functions: no shuffle, no join, no Python on the executors.

Null urls and urls without "://" have an empty host and path, fit no rule and are judged
by the model's bias. Repeated rows are judged alike; an empty table gives an empty one.
Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import ascii_lower

#: (host, path, verdict); the longest fitting rule wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: The small labelled table: hosts (with paths) of junk sites, and of ordinary ones.
BLOCK = """
cheap-pills.test/buy casino-win.test/play free-bets.test/now spam-farm.test/list ads-track.test/pixel www.cheap-meds.test/order pills-online.test/shop
casino-bonus.test/slots win-casino.test/spin bets-free.test/odds free-casino.test/go track-ads.test/click adserver-track.test/i spam-links.test/page
farm-spam.test/links cheap-viagra.test/pharmacy best-poker.test/win lottery-win.test/claim win-prize.test/now free-money.test/get payday-loans.test/apply
cheap-loans.test/fast xxx-cams.test/free adult-dating.test/join porn-free.test/watch replica-watches.test/sale cheap-replica.test/bags seo-links.test/buy
link-farm.test/out click-bait.test/win free-spins.test/casino bet-now.test/live sportsbets.test/free m.casino-club.test/win blog.cheap-pills.test/en/4
m.free-bets.test/de/71 www.casino-win.test/fr/12 ads-click.test/en/9 spam-mail.test/en/61 www.spam-farm.test/en/30 spam-farm.test/de/8.html adult-x.test/en/5 www.adult-x.test/en/41 m.ads-track.test/fr/6 free-bets.test/en/1
popup-ads.test/es/3 tracker-ads.test/en/17 pills-cheap.test/fr/8
""".split()
ALLOW = """
www.university.test/research blog.gardening.test/tips news.daily.test/world docs.library.test/guide en.wiki.test/article museum.test/visit
www.thirton.test/en/12 blog.ering.test/de/4 m.nationer.test/fr/90 thandre.test/es/7 www.theat.test/en/33 blog.onthe.test/en/8 therest.test/fr/5
thathon.test/en/15 m.herion.test/en/2 blog.stand.test/es/61 ththin.test/en/44 www.ither.test/de/9 anderen.test/de/71 nationth.test/en/5 blog.reth.test/fr/3
weather.test/forecast www.city.test/council school.test/courses health.test/advice science.test/journal recipes.test/bread music.test/albums
www.books.test/review m.travel.test/guide blog.history.test/romans software.test/manual mathematics.test/proof forum.test/thread cinema.test/reviews
www.hospital.test/doctors parliament.test/debates archive.test/letters language.test/grammar birds.test/species m.railway.test/times thehouse.test/en/25
""".split()

DIM = 4096
SIZES = (3, 4, 5)


def _grams(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for n in SIZES:
        for i in range(len(text) - n + 1):
            h = n
            for c in text[i : i + n]:
                h = (h * 31 + ord(c)) % 1_000_003
            out[h % DIM] = out.get(h % DIM, 0) + 1
    return out


@lru_cache(maxsize=4)
def fit(block: tuple = tuple(BLOCK), allow: tuple = tuple(ALLOW), rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[float, ...]:
    """Weights of DIM buckets and a bias, by logistic regression; the same on every run.

    A URL's features are its n-gram counts divided by their number. The examples' domain
    ending is left out, so that the model doesn't learn it.
    """
    rows = []
    for label, urls in ((1.0, block), (0.0, allow)):
        for url in urls:
            host, _, path = url.partition("/")
            grams = _grams(re.sub("[0-9]+", "0", f"^{host.removesuffix('.test')}/{path}$"))
            n = sum(grams.values()) or 1
            rows.append((label, {k: v / math.sqrt(n) for k, v in grams.items()}))
    w, bias = [0.0] * DIM, 0.0
    for _ in range(rounds):
        grad: dict[int, float] = {}
        shift = 0.0
        for label, x in rows:
            err = 1 / (1 + math.exp(-bias - sum(w[k] * v for k, v in x.items()))) - label
            shift += err
            for k, v in x.items():
                grad[k] = grad.get(k, 0.0) + err * v
        for k, g in grad.items():
            w[k] -= rate * (g / len(rows) + decay * w[k])
        bias -= rate * shift / len(rows)
    return (*(round(x, 6) for x in w), round(bias, 6))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Equal lengths: the first in text order."""
    best = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1]), reverse=True)[::-1]:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def model_text(host: Column, path: Column) -> Column:
    """What the model reads: the host without its last label, and the path without digits' values."""
    return F.concat(F.lit("^"), F.regexp_replace(host, r"\.[^.]*\z", ""), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))


def _bucket(codes: Column, n: int):
    """The bucket of the n-gram that starts at a place."""

    def at(i: Column) -> Column:
        h = F.lit(n)
        for j in range(n):
            h = (h * 31 + codes[i + j]) % 1_000_003
        return h % DIM

    return at


def codes_of(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def logit(codes: Column, weights: tuple[float, ...]) -> Column:
    """Bias plus the scaled weights of all hashed n-grams of a text, given as an array of code points."""
    table = F.split(F.lit(",".join(map(str, weights[:-1]))), ",").cast("array<double>")
    total, count = F.lit(0.0), F.lit(0)
    for n in SIZES:
        last = F.size(codes) - n + 1
        spots = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), _bucket(codes, n))).otherwise(F.array().cast("array<int>"))
        total = total + F.aggregate(spots, F.lit(0.0), lambda acc, k: acc + table[k])
        count = count + F.greatest(last, F.lit(0))
    return F.lit(weights[-1]) + total / F.sqrt(F.greatest(count, F.lit(1)).cast("double"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, weights: tuple[float, ...] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict and junk_score of each row."""
    weights = weights or fit()
    named = pages.select(F.col(key), F.col(url).alias("_u"))
    parts = named.select(key, host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"))
    ruled = parts.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("_c", codes_of(model_text(F.col("host"), F.col("path")))).withColumn("_z", logit(F.col("_c"), weights))
    return scored.select(
        key, "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(F.col("_z") > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-F.col("_z")))).alias("junk_score"),
    )
