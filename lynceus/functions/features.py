"""The lexical features of a URL, all of them column expressions over the parsed struct.

`extract` adds a struct column f of doubles, in the order of FEATURES, and tld, the whole public suffix. It is null
where the host is unknown. The expressions are spread over a few projections, so each intermediate value is
computed once and no generated method grows too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions import values as V
from lynceus.functions.text import count_of, entropy, max_run, n_digits, n_letters, n_non_ascii, n_upper, one_zero, switches, tokens, unquote
from lynceus.functions.url import canonical


def _listed(words: list[str]) -> str:
    """Words as SQL literals; a long list costs one call this way, and one for each word otherwise."""
    return ", ".join(f"'{w}'" for w in words)


LONG_BRANDS = [b for b in V.BRANDS if len(b) >= 5]


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, grouped by first letter so that a place without one fails at once."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{a}(?:{'|'.join(sorted(w[1:] for w in words if w[0] == a))})" for a in firsts)


LONG_BRAND = _any_of(LONG_BRANDS)
#: The long brands whose length differs by at most one from the place in this list, as SQL.
NEAR_LENGTH = [f"array({_listed([b for b in LONG_BRANDS if abs(len(b) - n) <= 1])})" for n in range(max(map(len, LONG_BRANDS)) + 2)]


def names_brand(words: str, text: str, other_than: str) -> Column:
    """Whether a brand other than the given word is among words, or a longer one anywhere in text; all are names of columns, or SQL."""
    whole = f"exists({words}, w -> w IN ({_listed(V.BRANDS)}) AND w <> {other_than})"
    others = f"exists(array({_listed(LONG_BRANDS)}), b -> contains({text}, b) AND b <> {other_than})"
    return F.expr(f"{whole} OR ({text} RLIKE '{LONG_BRAND}' AND ({other_than} NOT IN ({_listed(LONG_BRANDS)}) OR {others}))")


def is_typo(word: str) -> Column:
    """Whether a word of 5 to 40 characters (the name of a column) is one edit away from a long brand, and none itself."""
    near = f"element_at(array({', '.join(f'cast({x} AS array<string>)' for x in NEAR_LENGTH)}), length({word}) + 1)"
    return F.expr(f"length({word}) BETWEEN 5 AND {len(NEAR_LENGTH) - 1} AND {word} NOT IN ({_listed(LONG_BRANDS)}) AND exists({near}, b -> levenshtein(b, {word}, 1) = 1)")


def folded(word: Column) -> Column:
    """A word with look-alike characters, digits and pairs replaced by what they imitate."""
    plain = F.when(F.contains(word, F.lit("xn--")), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), word), word)).otherwise(word)
    plain = F.translate(F.translate(plain, *V.CONFUSABLE), "".join(V.LEET), "".join(V.LEET.values()))
    return F.replace(F.replace(plain, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _parts() -> list[dict[str, Column]]:
    """Intermediate columns, each layer using those before it."""
    p = lambda k: F.col(f"_p.{k}")
    c = F.col
    return [
        {
            "_u": canonical(F.col("_p")), "_host": p("host"), "_sub": p("sub"), "_reg": p("reg"), "_suffix": p("suffix"), "_query": p("query"),
            "_path": F.when(p("path") == "", "/").otherwise(p("path")),
            "_sld": F.when((p("suffix") != "") & F.endswith(p("reg"), F.concat(F.lit("."), p("suffix"))), F.substring(p("reg"), F.lit(1), F.length(p("reg")) - F.length(p("suffix")) - 1)).otherwise(p("reg")),
        },
        {
            "_rest": F.lower(unquote(F.concat(c("_path"), F.when(c("_query") != "", F.concat(F.lit("?"), c("_query"))).otherwise("")))),
            "_L": F.greatest(F.length("_u"), F.lit(1)).cast("double"), "_nd": n_digits(c("_u")), "_na": n_letters(c("_u")), "_nhd": n_digits(c("_host")),
            "_labels": F.split("_host", "\\.", -1), "_segs": F.array_remove(F.split("_path", "/", -1), ""),
            "_params": F.transform(F.array_remove(F.split("_query", "&", -1), ""), lambda kv: F.lower(F.substring_index(kv, "=", 1))),
            "_host_tokens": tokens(F.concat_ws(" ", "_sub", "_sld")), "_sub_tokens": tokens(c("_sub")), "_sld_tokens": tokens(c("_sld")),
            "_sld_is_brand": F.expr(f"_sld IN ({_listed(V.BRANDS)})"), "_fold": folded(c("_sld")), "_sld_letters": F.regexp_replace("_sld", "[^\\p{L}]", ""),
        },
        {
            "_last": F.when(F.size("_segs") > 0, F.lower(F.element_at("_segs", -1))).otherwise(""), "_rest_tokens": tokens(c("_rest")),
        },
        {"_ext": F.when(F.contains("_last", F.lit(".")), F.substring_index("_last", ".", -1)).otherwise("")},
    ]


def _features() -> dict[str, Column]:
    c, p = F.col, lambda k: F.col(f"_p.{k}")
    u, host, sub, sld, path, query, suffix = (c(f"_{k}") for k in ("u", "host", "sub", "sld", "path", "query", "suffix"))
    labels = F.size("_labels")
    inside = lambda w: F.contains(c("_rest"), F.lit(w))
    among = lambda words, name: F.expr(f"{name} IN ({_listed(words)})")
    member = lambda hosts, *names: F.greatest(*[one_zero(among(hosts, x)) for x in names])
    longest = lambda words: F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
    suspicious = lambda name: F.expr(f"size(filter({name}, w -> w IN ({_listed(V.SUSPICIOUS_WORDS)})))")
    host_words = sum((F.when(F.contains(host, F.lit(w)) & ~F.array_contains("_host_tokens", w), 1).otherwise(0) for w in V.HOST_WORDS), F.lit(0))
    out = {
        "url_len": F.length(u), "scheme_http": one_zero(p("scheme") == "http"), "has_userinfo": one_zero(p("userinfo") != ""), "n_at": count_of(u, "@"),
        "has_port": one_zero(p("port").isNotNull()), "port_nonstd": one_zero(~F.coalesce(p("port"), F.lit("80")).isin("80", "443")),
        **{f"n_{name}": count_of(u, mark) for name, mark in V.MARKS.items()},
        "digit_ratio": c("_nd") / c("_L"), "letter_ratio": c("_na") / c("_L"), "upper_ratio": n_upper(u) / c("_L"), "special_ratio": (c("_L") - c("_nd") - c("_na")) / c("_L"),
        "url_entropy": entropy(u), "n_pct_encoded": F.size(F.split(u, "%[0-9a-fA-F]{2}", -1)) - 1, "non_ascii": n_non_ascii(u),
        "double_slash_in_path": one_zero(F.contains(path, F.lit("//"))), "embedded_url": one_zero(inside("http:") | inside("https:") | inside("www.")),
        "n_params": F.size("_params"), "redirect_param": one_zero(F.expr(f"exists(_params, k -> k IN ({_listed(V.REDIRECT_PARAMETERS)}))")),
        "host_len": F.length(host), "host_n_labels": labels, "n_sub_labels": F.when(sub == "", 0).otherwise(F.size(F.split(sub, "\\.", -1))), "sub_len": F.length(sub),
        "www_prefix": one_zero(c("_labels")[0] == "www"), "host_n_hyphens": count_of(host, "-"), "host_n_digits": c("_nhd"), "host_digit_ratio": _ratio(c("_nhd"), F.length(host)),
        "host_is_ip": one_zero(p("ip") > 0), "host_is_ipv6": one_zero(p("ip") == 6), "host_punycode": one_zero(F.contains(host, F.lit("xn--"))),
        "host_invalid_chars": one_zero((p("ip") == 0) & host.rlike("[^a-z0-9.\\-_]")), "host_entropy": entropy(host), "host_max_label_len": longest(c("_labels")),
        "sub_has_digit": one_zero(n_digits(sub) > 0), "sub_has_hyphen": one_zero(F.contains(sub, F.lit("-"))),
        "sld_len": F.length(sld), "sld_entropy": entropy(sld), "sld_n_digits": n_digits(sld), "sld_n_hyphens": count_of(sld, "-"),
        "sld_vowel_ratio": _ratio(F.length(F.regexp_replace("_sld_letters", "[^aeiou]", "")), F.length("_sld_letters")),
        "sld_max_consonant_run": max_run(sld, "[b-df-hj-np-tv-z]"), "sld_max_digit_run": max_run(sld, "[0-9]"), "sld_digit_letter_switches": switches(sld),
        "tld_len": F.length(F.substring_index(suffix, ".", -1)), "suffix_n_labels": F.when(suffix == "", 0).otherwise(count_of(suffix, ".") + 1),
        "private_suffix": one_zero(p("private_suffix")), "user_content_host": member(V.USER_CONTENT_HOSTS, "_host", "_reg", "_suffix"), "shortener": member(V.SHORTENERS, "_host", "_reg"),
        "path_len": F.length(path), "path_depth": F.size("_segs"), "path_max_seg_len": longest(c("_segs")), "path_digit_ratio": _ratio(n_digits(path), F.length(path)),
        "path_entropy": entropy(path), "query_len": F.length(query),
        "ext_server": one_zero(among(V.SERVER_EXTENSIONS, "_ext")), "ext_page": one_zero(among(V.PAGE_EXTENSIONS, "_ext")), "ext_risky": one_zero(among(V.RISKY_EXTENSIONS, "_ext")),
        "is_homepage": one_zero((F.size("_segs") == 0) & (query == "")),
        "sus_words_host": suspicious("_host_tokens") + host_words, "sus_words_path": suspicious("_rest_tokens"),
        "wp_path": one_zero(inside("wp-content") | inside("wp-includes") | inside("wp-admin")),
        "brand_is_sld": one_zero(c("_sld_is_brand")), "brand_in_sld_not_equal": one_zero(~c("_sld_is_brand") & names_brand("_sld_tokens", "_sld", "''")),
        "brand_in_sub": one_zero(names_brand("_sub_tokens", "_sub", "_sld")), "brand_in_path": one_zero(names_brand("_rest_tokens", "_rest", "_sld")),
        "brand_typo": one_zero(~c("_sld_is_brand") & (is_typo("_sld") | ((c("_fold") != sld) & among(V.BRANDS, "_fold")))),
        "n_host_tokens": F.size("_host_tokens"), "suffix_gov_edu": one_zero(suffix.rlike(V.GOV_EDU)),
    }
    return {k: v.cast("double") for k, v in out.items()}


#: The features in model order; tld_logit, which needs a reputation table, comes last in a model.
FEATURES = (
    "url_len scheme_http has_userinfo n_at has_port port_nonstd " + " ".join(f"n_{m}" for m in V.MARKS) + " digit_ratio letter_ratio upper_ratio special_ratio "
    "url_entropy n_pct_encoded non_ascii double_slash_in_path embedded_url n_params redirect_param host_len host_n_labels n_sub_labels sub_len www_prefix "
    "host_n_hyphens host_n_digits host_digit_ratio host_is_ip host_is_ipv6 host_punycode host_invalid_chars host_entropy host_max_label_len sub_has_digit "
    "sub_has_hyphen sld_len sld_entropy sld_n_digits sld_n_hyphens sld_vowel_ratio sld_max_consonant_run sld_max_digit_run sld_digit_letter_switches tld_len "
    "suffix_n_labels private_suffix user_content_host shortener path_len path_depth path_max_seg_len path_digit_ratio path_entropy query_len ext_server ext_page "
    "ext_risky is_homepage sus_words_host sus_words_path wp_path brand_is_sld brand_in_sld_not_equal brand_in_sub brand_in_path brand_typo n_host_tokens suffix_gov_edu"
).split()


def extract(df: DataFrame, parsed: str = "p", names: list[str] | None = None) -> DataFrame:
    """df with f, a struct of the named features (all by default), and tld. Both are null where the host is empty."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("f", "tld")]
    step = df.withColumn("_p", F.col(parsed))
    for layer in _parts():
        step = step.withColumns(layer)
    wanted = _features()
    known = F.col("_p.host") != ""
    f = F.struct(*[wanted[k].alias(k) for k in (names or FEATURES)])
    return step.select(*kept, F.when(known, f).alias("f"), F.when(known, F.col("_suffix")).alias("tld"))


def popularity(reg: Column, rank: Column) -> dict[str, Column]:
    """Optional features from a ranked list: log10 of the rank, 7 where there is none, and whether there is one."""
    return {"popular_rank_log": F.coalesce(F.log10(rank), F.lit(7.0)), "is_popular": one_zero(rank.isNotNull())}
