"""Column -> Column functions of the observation engine: slugs, URLs, boxes, gates, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, where nested functions of arrays would evaluate it at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def url_norm(url: Column) -> Column:
    """Without query, fragment and the parameters of the last path segment."""
    plain = F.regexp_replace(url, "[?#].*$", "")
    return F.regexp_replace(plain, ";[^/]*$", "")


def storage_uri(url: Column) -> Column:
    """An object's https URL as ``gs://bucket/object``; others stay."""
    path = F.regexp_extract(url, r"^https://storage\.(?:googleapis|cloud\.google)\.com/([^?#]*)", 1)
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path != "", F.concat(F.lit("gs://"), decoded)).otherwise(url)


def redact_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^/@]*@", "://***@")


def valid_slug(s: Column) -> Column:
    return s.rlike(r"\A[a-z0-9_]+\z") & (F.char_length(s) <= 63)


def foot_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 matrix; w = 0 gives (0, 0)."""
    row = lambda i: F.element_at(F.element_at(h, i), 1) * x + F.element_at(F.element_at(h, i), 2) * y + F.element_at(F.element_at(h, i), 3)
    w = row(3)
    return F.when(w == 0, 0.0).otherwise(row(1) / F.nullif(w, F.lit(0.0))), F.when(w == 0, 0.0).otherwise(row(2) / F.nullif(w, F.lit(0.0)))


def distorted(x: Column, y: Column, k: list[list[float]], d: list[float]) -> tuple[Column, Column]:
    """Where a pinhole camera with radial and tangential distortion (k1, k2, p1, p2, k3) shows an ideal place."""
    u, v = (x - k[0][2]) / k[0][0], (y - k[1][2]) / k[1][1]
    r2 = u * u + v * v
    radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
    a = u * radial + 2 * d[2] * u * v + d[3] * (r2 + 2 * u * u)
    b = v * radial + d[2] * (r2 + 2 * v * v) + 2 * d[3] * u * v
    return a * k[0][0] + k[0][2], b * k[1][1] + k[1][2]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def hundredths(x: Column) -> Column:
    """A double from 0 to below 4 with two decimals, as C's printf gives it: its exact binary value is rounded, ties go to the even digit.

    ``format_string`` rounds the shortest decimal text instead, and ties up. All that is not rounded to 0.00 anyway is whole in units of
    2**-60; the part below 1 is multiplied by 100 in two halves.
    """
    half = (1 << 30) - 1

    def cut(v: Column) -> Column:
        low = v.bitwiseAND(F.lit(half)) * 100
        high = F.shiftright(v, 30).bitwiseAND(F.lit(half)) * 100 + F.shiftright(low, 30)
        rest = F.shiftleft(high.bitwiseAND(F.lit(half)), 30).bitwiseOR(low.bitwiseAND(F.lit(half)))
        return F.struct((F.shiftright(v, 60) * 100 + F.shiftright(high, 30)).alias("n"), rest.alias("rest"))

    def text(v: Column) -> Column:
        n, rest = v["n"], v["rest"]
        n = n + F.when((rest > 2**59) | ((rest == 2**59) & (n % 2 == 1)), 1).otherwise(0)
        return F.format_string("%d.%02d", F.floor(n / 100), n % 100)

    return let((x * float(2**60)).cast("long"), lambda v: let(cut(v), text))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Zero vectors stay zero."""
    return let(l2_norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


#: Schemes, hosts and domains that a fetch may or may not reach.
SCHEMES = ["https", "http", "gs"]
BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "metadata.google.com", "169.254.169.254", "metadata"]
ALLOWED_DOMAINS = ["storage.googleapis.com", "storage.cloud.google.com"]
#: IPv4 networks that are never fetched from, as address/prefix length.
BLOCKED_NETWORKS = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4"]


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return reduce(lambda a, i: a * 256 + F.element_at(parts, i).cast("long"), range(2, 5), F.element_at(parts, 1).cast("long"))


def in_network(number: Column, network: str) -> Column:
    base, bits = network.split("/")
    first = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
    return number.between(first, first + 2 ** (32 - int(bits)) - 1)


def url_verdict(url: Column) -> Column:
    """Why a URL may not be fetched, or ``ok``; checks in the order scheme, host, blocked host, address, domain."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))

    def address(number: Column) -> Column:
        blocked = reduce(lambda a, b: a | b, [in_network(number, n) for n in BLOCKED_NETWORKS])
        return F.when(blocked, "blocked range").otherwise("ok")

    def of_host(h: Column) -> Column:
        ipv4 = h.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
        allowed = reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in ALLOWED_DOMAINS])
        ipv6_blocked = h.rlike(r"^\[(::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$")
        return (
            F.when(h == "", "no host")
            .when(h.isin(BLOCKED_HOSTS), "blocked host")
            .when(ipv4, let(ipv4_number(h), address))
            .when(h.startswith("["), F.when(ipv6_blocked, "blocked range").otherwise("ok"))
            .when(allowed, "ok")
            .otherwise("domain not allowed")
        )

    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when(url.startswith("gs://"), F.when(url.rlike("^gs://[^/]+(/.*)?$"), "ok").otherwise("invalid bucket url"))
        .when(~scheme.isin(SCHEMES), "blocked scheme")
        .otherwise(let(host, of_host))
    )


def dead_letter_queue(task: Column) -> Column:
    """The first name that the task contains decides."""
    out = F.lit("dlq:unknown")
    #: Names and their queues, in order of precedence.
    for name, queue in reversed([("embedding", "dlq:embeddings"), ("camera", "dlq:camera_frames"), ("yolo", "dlq:yolo"), ("face", "dlq:face"), ("detection", "dlq:detections")]):
        out = F.when(F.contains(F.lower(task), F.lit(name)), queue).otherwise(out)
    return out


def band(x: Column, warn: float, bad: float) -> Column:
    return F.when(x >= bad, "bad").when(x >= warn, "warn").otherwise("ok")
