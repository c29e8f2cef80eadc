"""URLs as columns. Identity, kind and origin of a URL; percent and IDN re-encoding stay with the connectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_scheme(url: Column) -> Column:
    t = F.trim(url)
    return F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def authority(url: Column) -> Column:
    """Host and port in lower case, without userinfo."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":[0-9]*$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """The identity of a URL: https, host without www, no default port, userinfo, fragment or tracking parameters, parameters in order, no trailing slash. Null where there is none."""
    return let(with_scheme(url), lambda full: _canonical(full, url))


def _canonical(full: Column, url: Column) -> Column:
    key = lambda p: F.lower(F.split(p, "=")[0])
    kept = F.filter(F.split(query(full), "&"), lambda p: (p != "") & ~F.startswith(key(p), F.lit("utm_")) & ~key(p).isin(*L.TRACKING))
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(F.split(p, "=")[0].alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    place = F.when(path(full) == "/", F.lit("/")).otherwise(F.regexp_replace(path(full), "(?<=.)/+$", ""))
    where = F.regexp_replace(F.regexp_replace(authority(full), r"^www\.", ""), ":(80|443)$", "")
    video = F.regexp_replace(path(full), "^/+|/+$", "")
    plain = F.concat(F.lit("https://"), where, place, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    short = F.when((host(full) == "youtu.be") & (video != ""), F.concat(F.lit("https://youtube.com/watch?v="), video)).otherwise(plain)
    return F.when(scheme(full).isin("http", "https") & (host(full) != "") & (F.trim(url) != ""), short)


def kind(url: Column) -> Column:
    """What a URL is, as far as it tells itself."""
    h, p = bare_host(url), F.lower(path(url))
    of = lambda name: (h == name) | F.endswith(h, F.lit(f".{name}"))
    return (
        F.when(of("github.com"), "github")
        .when(of("youtube.com") | (h == "youtu.be"), "youtube")
        .when(of("arxiv.org") | (h == "doi.org") | h.rlike(r"(biorxiv\.org|openreview\.net|semanticscholar\.org)$") | F.endswith(p, F.lit(".pdf")), "research")
        .when(h.rlike(r"^docs\.|\.readthedocs\.io$|^docs\.rs$") | p.rlike("^/docs(/|$)|/documentation/"), "documentation")
        .when(p.rlike(r"\.rss$|/rss$|/rss\.xml$"), "rss")
        .when(p.rlike(r"\.atom$|/atom\.xml$"), "atom")
        .when(F.endswith(p, F.lit("feed.json")), "json_feed")
        .otherwise("web")
    )


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.regexp_replace(authority(url), ":(80|443)$", ""))


def same_site(seed: Column, url: Column) -> Column:
    """Whether url is on the host of seed, www or not and by the same port, or on a subdomain."""
    a, b = bare_host(seed), bare_host(url)
    return ((a == b) & (port(seed) == port(url))) | F.endswith(b, F.concat(F.lit("."), a))


def port(url: Column) -> Column:
    named = F.regexp_extract(authority(url), ":([0-9]+)$", 1)
    return F.when(named != "", named).when(scheme(url) == "http", "80").otherwise("443")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def section_of(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in L.SECTION_OF.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(word)))


def policy_error(url: Column) -> Column:
    """Why a URL must not be fetched; null if it may."""
    h = F.regexp_replace(host(url), r"\.$", "")
    octet = lambda k: F.regexp_extract(h, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", k).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    private = (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 240)
    )
    v6 = F.regexp_extract(authority(url), r"^\[([0-9a-f:.]+)\]", 1)
    private6 = v6.isin("::1", "::") | v6.rlike("^f[cd]|^fe[89ab]") | v6.rlike(r"^::ffff:(10\.|127\.|192\.168\.|169\.254\.|0\.)")
    named = (h == "localhost") | h.rlike(r"\.(localhost|local|internal)$")
    userinfo = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*@)?", 1) != ""
    return (
        F.when(~scheme(url).isin("http", "https"), F.concat(F.lit("unsupported scheme '"), scheme(url), F.lit("'")))
        .when(userinfo, "URLs with embedded credentials are not fetched")
        .when(authority(url) == "", "URL has no host")
        .when(F.coalesce(private, F.lit(False)) | private6 | named, F.concat(h, F.lit(" is not a public address")))
    )


def x_account(url: Column) -> Column:
    handle = F.get(segments(url), F.lit(0))
    return F.when(bare_host(url).isin(*L.X_HOSTS) & handle.rlike("^[A-Za-z0-9_]{1,15}$") & ~F.lower(handle).isin(*L.X_RESERVED), handle)


def github_repository(url: Column) -> Column:
    parts = segments(url)
    return F.when((bare_host(url) == "github.com") & (F.size(parts) >= 2) & ~parts[0].isin(*L.GITHUB_RESERVED), F.concat(parts[0], F.lit("/"), F.regexp_replace(parts[1], r"(\.git)+$", "")))


def target(text: Column) -> Column:
    """What an observation names: struct(scope, canonical, error). `/*` at the end means all beneath; any other * is an error."""
    t = F.trim(text)
    beneath = F.endswith(t, F.lit("/*"))
    body = F.when(beneath, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    full = with_scheme(body)
    clean = F.when(beneath, F.regexp_replace(full, "(?<!:)/{2,}", "/")).otherwise(full)

    def judged(found: Column) -> Column:
        error = F.when(t == "", "empty").when(F.contains(body, F.lit("*")) | F.contains(F.lower(body), F.lit("%2a")), "misplaced operator").when(found.isNull(), "invalid")
        closed = F.when(beneath & ~F.endswith(found, F.lit("/")), F.concat(found, F.lit("/"))).otherwise(found)
        return F.struct(F.when(beneath, "descendants").otherwise("resource").alias("scope"), F.when(error.isNull(), closed).alias("canonical"), error.alias("error"))

    return let(canonical(clean), judged)
