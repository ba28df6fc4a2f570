"""URL parsing as browsers do it, in column expressions.

`parse` adds a struct column p: url, scheme, netloc, userinfo, host, host_unicode, port, port_error, path, query,
fragment, sub, reg, suffix, private_suffix and ip (0, 4 or 6). Where the host can't be told, host is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.suffix import SuffixRules, split_hosts
from lynceus.functions.text import is_ascii, settled, strip, unquote

HEX = "[0-9a-fA-F]{1,4}"
SPLIT = "^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#([\\s\\S]*))?"
FIELDS = "url scheme netloc userinfo host host_unicode port port_error path query fragment sub reg suffix private_suffix ip".split()


def normalise(raw: Column) -> tuple[Column, Column]:
    """(URL with its authority marked, lower-case scheme or ''), from text as people write it."""
    s = F.regexp_replace(F.regexp_replace(strip(raw), '^"+|"+$', ""), "^'+|'+$", "")
    s = F.replace(s, F.lit("\\"), F.lit("/"))
    web, other = "(?i)^(https?|ftp|wss?)\\s*:/*", "^([a-zA-Z][a-zA-Z0-9+.\\-]*)://"
    scheme = F.lower(F.when(s.rlike(web), F.regexp_extract(s, web, 1)).otherwise(F.regexp_extract(s, other, 1)))
    url = F.when(s.rlike(web), F.concat(scheme, F.lit("://"), F.regexp_replace(s, web, ""))).when(s.rlike(other), s).otherwise(F.concat(F.lit("//"), F.regexp_replace(s, "^/+", "")))
    return url, scheme


def is_ipv6(h: Column) -> Column:
    """Whether a text without brackets is an IPv6 address, with a dotted tail or a zone or without."""
    zone = F.regexp_replace(h, "%[^%]+$", "")
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    plain = F.regexp_replace(zone, f"(?<=:){octet}(?:\\.{octet}){{3}}$", "0:0")
    full = plain.rlike(f"^(?:{HEX}:){{7}}{HEX}$")
    short = plain.rlike(f"^(?:{HEX}(?::{HEX})*)?::(?:{HEX}(?::{HEX})*)?$") & (F.size(F.array_remove(F.split(plain, ":"), "")) <= 7)
    return full | short


def _legacy_part(x: Column) -> Column:
    """The value of one part of an IPv4 address, or null: hexadecimal, octal or decimal."""
    hexa = F.conv(F.regexp_replace(x, "^0[xX]0*(?=.)", ""), 16, 10)
    octal = F.conv(F.regexp_replace(x, "^0+(?=.)", ""), 8, 10)
    value = F.when(x.rlike("^0[xX][0-9a-fA-F]+$"), hexa).when(x.rlike("^0[0-7]+$"), octal).when(x.rlike("^(0|[1-9][0-9]{0,4299})$"), F.when(F.length(x) > 19, F.lit("9999999999")).otherwise(x))
    return value.cast("decimal(20,0)")


def ip_version(host: Column) -> Column:
    """6, 4 (hexadecimal, octal and single-number spellings too) or 0."""
    h = F.regexp_replace(host, "^[\\[\\]]+|[\\[\\]]+$", "")
    parts = F.split(h, "\\.", -1)
    values = F.transform(parts, _legacy_part)
    four = h.rlike("^[0-9a-fA-FxX.]+$") & (F.size(parts) <= 4) & ~F.exists(values, lambda v: v.isNull()) & ((F.size(parts) > 1) | (values[0] > 16777215))
    return F.when(F.contains(h, F.lit(":")) & is_ipv6(h), 6).when(four, 4).otherwise(0)


def to_ascii(host: Column) -> Column:
    """The ASCII form of an international host; one that has none stays as it is."""
    return F.when(is_ascii(host), host).otherwise(F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1)), host))


def parse(df: DataFrame, column: str = "url", rules: SuffixRules | None = None, out: str = "p") -> DataFrame:
    """df with the struct column out; a null URL has an empty host. No Python and no shuffle is involved."""
    kept = df.columns
    url, scheme = normalise(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    step = df.withColumns({"_url": url, "_scheme": scheme})
    clean = F.regexp_replace(F.regexp_replace("_url", "^[\\x00-\\x20]+", ""), "[\\t\\r\\n]", "")
    step = step.withColumn("_clean", clean)
    part = lambda k: F.regexp_extract("_clean", SPLIT, k)
    step = step.withColumns({"_netloc": part(2), "_path": part(3), "_query": part(4), "_fragment": part(5)})
    inside = F.regexp_extract("_netloc", "^(?:[^\\[\\]]*@)?\\[([^\\[\\]]*)\\](?::[^\\[\\]]*)?$", 1)
    sound = ~F.col("_netloc").rlike("[\\[\\]]") | is_ipv6(inside) | inside.rlike("^[vV][0-9a-fA-F]+\\.[\\s\\S]+$")
    step = step.withColumn("_netloc", F.when(sound, F.col("_netloc")).otherwise(F.regexp_replace("_netloc", "[\\[\\]]", "")))
    at = F.contains("_netloc", F.lit("@"))
    step = step.withColumns({"_user": F.when(at, F.regexp_extract("_netloc", "^([\\s\\S]*)@", 1)).otherwise(""), "_at": F.substring_index("_netloc", "@", -1)})
    bracket, colon = F.startswith("_at", F.lit("[")), F.length("_at") - F.length(F.replace("_at", F.lit(":"))) == 1
    in_bracket = F.regexp_extract("_at", "^(\\[[^\\]]*\\])", 1)
    host = F.when(bracket, in_bracket).when(colon, F.substring_index("_at", ":", 1)).otherwise(F.col("_at"))
    port = F.when(bracket, F.when(F.col("_at").rlike("^\\[[^\\]]*\\]:"), F.regexp_extract("_at", "^\\[[^\\]]*\\]:([\\s\\S]*)$", 1))).when(colon, F.nullif(F.substring_index("_at", ":", -1), F.lit("")))
    step = step.withColumns({"_host": F.lower(F.regexp_replace(strip(host), "\\.+$", "")), "_port": port})
    step = step.withColumn("_unicode", unquote(F.col("_host"))).withColumn("_host", to_ascii(F.col("_unicode")))
    step = step.withColumn("_ip", F.when(F.col("_host") == "", 0).otherwise(ip_version(F.col("_host"))))
    bad_port = F.col("_port").isNotNull() & ~(F.col("_port").rlike("^0*[1-9][0-9]{0,4}$") & (F.try_to_number(F.substring(F.regexp_replace("_port", "^0+(?=.)", ""), 1, 5), F.lit("99999")) < 65536))
    step = settled(step, {"_host": F.col("_host"), "_ip": F.col("_ip"), "_bad": bad_port})
    step = split_hosts(step, F.when((F.col("_ip") > 0) | (F.col("_host") == ""), F.lit(None)).otherwise(F.col("_host")), rules)
    whole = F.col("_sub").isNull()
    values = {
        "url": F.col("_url"), "scheme": F.col("_scheme"), "netloc": F.col("_netloc"), "userinfo": F.col("_user"), "host": F.col("_host"), "host_unicode": F.col("_unicode"),
        "port": F.col("_port"), "port_error": F.coalesce("_bad", F.col("_port").isNotNull()), "path": F.col("_path"), "query": F.col("_query"), "fragment": F.col("_fragment"),
        "sub": F.when(whole, "").otherwise(F.col("_sub")), "reg": F.when(whole, F.col("_host")).otherwise(F.col("_reg")), "suffix": F.when(whole, "").otherwise(F.col("_suffix")),
        "private_suffix": F.coalesce("_private", F.lit(False)), "ip": F.col("_ip"),
    }
    return settled(step.select(*[F.col(f"`{c}`") for c in kept if c != out], F.struct(*[values[k].alias(k) for k in FIELDS]).alias(out)), {out: F.col(out)})


def canonical(p: Column) -> Column:
    """scheme://authority/path?query, with https for a missing scheme and / for a missing path, without the fragment."""
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    return F.concat(F.when(p["scheme"] == "", "https").otherwise(p["scheme"]), F.lit("://"), p["netloc"], F.when(p["path"] == "", "/").otherwise(p["path"]), query)


def canonical_text(url: Column) -> Column:
    """What character models read: the stripped text without its fragment, with https for a missing scheme."""
    s = F.substring_index(strip(url), "#", 1)
    return F.when(F.contains(F.substring(s, 1, 12), F.lit("://")), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))


def loose_key(url: Column) -> Column:
    """Equal for spellings of one address: lower case, no fragment, scheme, www or last slash."""
    s = F.substring_index(F.lower(strip(url)), "#", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^[a-z]+://", ""), "^www\\.", ""), "/+$", "")


def surt(reg: Column) -> Column:
    """Labels in reverse, joined by commas: the order of crawl indexes."""
    return F.array_join(F.reverse(F.split(reg, "\\.")), ",")


def normal_target(path: Column, query: Column) -> Column:
    """Path and query for prefix matching: lower-case path, %2e decoded, dot segments resolved."""
    path = F.when(path == "", "/").otherwise(path)
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit(".")))
    empty = F.array().cast("array<string>")

    def walk(done: Column, s: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    segments = F.aggregate(parts, empty, walk)
    segments = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    return F.concat(F.lit("/"), F.array_join(segments, "/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def prefix_candidates(target: Column) -> Column:
    """All prefixes of target that end before or after a slash, the first question mark or a later ampersand, and target."""
    q = F.instr(target, "?")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(target), F.lit(1))), lambda i: (F.substring(target, i, F.lit(1)) == "/") | (i == q) | ((F.substring(target, i, F.lit(1)) == "&") & (q > 0) & (i > q)))
    cut = F.flatten(F.transform(places, lambda i: F.array(F.substring(target, F.lit(1), i - 1), F.substring(target, F.lit(1), i))))
    return F.array_distinct(F.concat(F.array(target), cut))


def parents(host: Column) -> Column:
    """The host and every domain above it, the longest first."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def looks_like_url(v: Column) -> Column:
    """Whether a cell looks like a URL: a scheme, or a host with a plausible last label; e-mail addresses don't."""
    v = strip(F.coalesce(v, F.lit("")))
    head = F.substring_index(v, "/", 1)
    host = F.substring_index(F.substring_index(head, "?", 1), ":", 1)
    last = F.element_at(F.split(host, "\\."), -1)
    domain = F.contains(host, F.lit(".")) & ~host.rlike("(^|\\.)(\\.|$)") & (last.rlike("^\\p{L}{2,}$") | F.replace(host, F.lit(".")).rlike("^\\p{Nd}+$"))
    from lynceus.functions.text import has_space

    return (F.length(v) >= 4) & ~has_space(v) & (F.contains(F.substring(v, 1, 12), F.lit("://")) | (~F.contains(head, F.lit("@")) & domain))


def strong_url(v: Column) -> Column:
    """Unmistakably a URL: it has a scheme, www. or a path."""
    s = strip(F.coalesce(v, F.lit("")))
    return looks_like_url(v) & (F.contains(F.substring(s, 1, 12), F.lit("://")) | F.startswith(F.lower(s), F.lit("www.")) | F.contains(s, F.lit("/")))
