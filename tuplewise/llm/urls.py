"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed n-grams (four hex digits of their md5, modulo BUCKETS), n-gram length, and what weights are multiplied by to be whole.
BUCKETS, N, UNIT = 16384, 4, 10_000
#: Log odds that speak for a page before its n-grams do: an unknown name is to be allowed.
CAUTION = 0.5
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table: what sites to block and sites to keep are about. A name is one of these words with an affix that
#: both kinds take; every HELD-th name is held out of training as a whole.
HELD = 5
_BAD = """casino roulette blackjack jackpot slots poker bets betting gambling bingo porn xxx adult erotic sexcam escort nude webcam
viagra cialis pharma pills steroids spam backlinks clickbait ads adclick popunder banner affiliate warez torrent crack keygen malware
phishing loans payday lottery prizes giveaway replica dating hookup doubler""".split()
_GOOD = """library museum school university college science physics biology chemistry history geography language grammar dictionary
journal newspaper weather climate ocean river mountain forest garden kitchen recipe baker coffee travel railway airport hospital clinic
dental nursing law court parliament council village city church family poetry theatre orchestra cinema gallery chess football tennis
cycling rowing software hardware database network linux python engineering energy farming wildlife birds""".split()
_AFFIXES = ("{}", "{}online", "my{}", "{}-zone", "the{}", "{}24", "best-{}", "{}-club", "{}world", "top{}", "{}-hub", "{}now", "e{}", "{}direct")
_BAD_PATHS = ("bonus/claim", "signup?aff=20177", "go/out.php?id=99", "track/click/8841", "win/now.html", "free/trial-offer", "promo?src=pop", "buy/cheap")
_GOOD_PATHS = ("about", "articles/2021/05/review.html", "docs/install", "archive/page/3", "en/contact", "events/calendar", "story/8841", "index.html#top")
#: Paths of both kinds of site: most urls are told by their host.
_PATHS = ("", "home", "en/", "page/2", "index.php?lang=en", "contact.html", "2023/11/04", "view?id=31")


def labelled_urls() -> list[tuple[str, int, bool]]:
    """The labelled table: (url, 1 for a page to block, whether its name is held out), 7 names for each word and 2 urls for each name, one in four of
    them with a path of its kind."""
    heads, ends = ("", "www.", "m.", "shop."), ("com", "org", "info", "co")
    out = []
    for bad, words, paths in ((1, _BAD, _BAD_PATHS), (0, _GOOD, _GOOD_PATHS)):
        names = [_AFFIXES[(i + 2 * j) % len(_AFFIXES)].format(word) for i, word in enumerate(words) for j in range(7)]
        for i, name in enumerate(names):
            for j in range(2):
                path = (paths if (i + 2 * j) % 4 == 0 else _PATHS)[(i // 4 + j) % 8]
                out.append((f"https://{heads[(i + j) % 4]}{name}.{ends[(i * 3 + j) % 4]}/{path}", bad, i % HELD == 0))
    return out


def split_url(url: str) -> tuple[str, str]:
    """Host and path as the columns have them."""
    head, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), tail[:end]


def _buckets(host: str, path: str) -> list[int]:
    words = [f"h^{host}$", f"p^{path}$"]
    return [int(hashlib.md5((w[0] + w[i : i + N]).encode()).hexdigest()[:4], 16) % BUCKETS for w in words for i in range(1, len(w) - N + 1)]


@lru_cache(maxsize=1)
def train(rounds: int = 60, rate: float = 0.25, ridge: float = 1e-4) -> tuple[int, tuple[int, ...]]:
    """Intercept and weights in whole units, by gradient steps over the labelled rows that are not held out, in a fixed order."""
    data = [(_buckets(*split_url(url)), bad) for url, bad, held in labelled_urls() if not held]
    weights, bias = [0.0] * BUCKETS, 0.0
    for r in range(rounds):
        step = rate / (1 + r / 20)
        for own, bad in data:
            size = max(1, len(own))
            z = bias + sum(weights[b] for b in own) / math.sqrt(size)
            miss = bad - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += step * miss * 0.1
            for b in own:
                weights[b] += step * (miss / math.sqrt(size) - ridge * weights[b])
    return round((bias - CAUTION) * UNIT), tuple(round(w * UNIT) for w in weights)


def host_and_path(url: Column) -> tuple[Column, Column]:
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, form, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits. Rules of one length: the first stands."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, mark, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(mark + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def margin(host: Column, path: Column) -> Column:
    """The intercept and the mean-scaled sum of weights, as (sum of weights, number of n-grams) compared without rounding."""
    bias, weights = train()
    # one literal that is split once: an array of literals would take as many calls
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")

    def total(kind: str, word: Column) -> tuple[Column, Column]:
        framed = F.concat(F.lit("^"), word, F.lit("$"))
        count = F.greatest(F.length(framed) - N + 1, F.lit(0))
        places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        bucket = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(kind), framed.substr(i, F.lit(N))).cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc + F.element_at(table, bucket(i) + 1)), count

    (a, n), (b, m) = total("h", host), total("p", path)
    return F.lit(bias) * F.sqrt(F.greatest(n + m, F.lit(1)).cast("double")) + a + b


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    The longest fitting rule decides; where none fits, the page is blocked if the
    regression's log odds are above 0. A null url, or one without ``://``, has
    empty host and path, fits no rule and is allowed or blocked by the intercept
    alone (it is allowed). All of a long url counts. Repeated rows repeat; an empty
    table gives none; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), *[c.alias(n) for c, n in zip(host_and_path(F.col(url)), ("host", "path"))])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(margin(F.col("host"), F.col("path")) > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def oracle_sql(rules=RULES) -> str:
    """The same rows in DuckDB's SQL, the trained weights being constants."""
    bias, weights = train()

    def total(kind: str, word: str) -> str:
        return f"list_sum(list_transform(range(1, greatest(length({word}) + {3 - N}, 0) + 1), lambda i: w[('0x' || md5('{kind}' || substr('^' || {word} || '$', i, {N}))[1:4])::INT % {BUCKETS} + 1]))"

    fits = [(text, kind, f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')") for kind, text in sorted(rules, key=lambda r: -len(r[1])) for own, _, rest in [text.partition("/")]]
    return f"""WITH model AS (SELECT [{", ".join(map(str, weights))}]::BIGINT[] AS w),
    parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    scored AS (SELECT page_id, host, path,
        {bias} * sqrt(greatest(greatest(length(host) + {3 - N}, 0) + greatest(length(path) + {3 - N}, 0), 1)::DOUBLE) + coalesce({total("h", "host")}, 0) + coalesce({total("p", "path")}, 0) AS z FROM parts, model)
    SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{t}'" for t, _, f in fits)} END AS rule,
        CASE {" ".join(f"WHEN {f} THEN '{k}'" for _, k, f in fits)} WHEN z > 0 THEN 'block' ELSE 'allow' END AS verdict FROM scored"""
