"""Features of strings: entropy, composition, e-mail addresses, names, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_int

#: Free and disposable mail providers, endings of ill repute, words that throw-away addresses hold.
FREEMAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "protonmail.com", "mail.com")
DISPOSABLE = ("mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "yopmail.com", "10minutemail.com")
RISKY_TLD = ("tk", "ml", "ga", "cf", "gq", "xyz", "click", "link", "download", "loan", "work")
SUSPICIOUS = ("temp", "burner", "trash", "spam", "fake", "anon", "test", "noreply", "dummy", "void", "null", "drop")
NO_NAME = 999.0


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters; 0 for empty, null for null."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(s.isNotNull(), F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))


def composition(s: Column) -> dict[str, Column]:
    """What a string, as the local part of an address, is made of: shares of its characters (0 of an empty one) and patterns of
    made-up names. Letters, digits and capitals are those of Unicode."""
    part = lambda pattern: F.regexp_count(s, F.lit(pattern)) / F.greatest(F.length(s), F.lit(1))
    return {
        "length": F.length(s), "digit_ratio": part(r"\p{Nd}"), "upper_ratio": part(r"\p{Lu}"), "special_ratio": part(r"[^\p{L}\p{N}]"), "has_plus": as_int(s.contains("+")), "starts_digit": as_int(s.rlike(r"^\p{Nd}")),
        "all_digits": as_int(s.rlike(r"^\p{Nd}+$")), "hex_like": as_int(s.rlike("^[0-9a-fA-F]{8,}$")), "uuid_like": as_int(s.rlike("^[0-9a-f]{8}-?[0-9a-f]{4}")), "sequential": as_int(F.lower(s).rlike("abc|123|xyz")),
    }


def email_features(email: Column) -> dict[str, Column]:
    """Parts and kinds of an address. A domain that is a disposable provider's or ends in a risky ending is disposable; one that
    is neither that nor a free provider's is its owner's own."""
    local, domain = F.split_part(email, F.lit("@"), F.lit(1)), F.split_part(email, F.lit("@"), F.lit(2))
    risky = domain.rlike(r"\.(" + "|".join(RISKY_TLD) + ")$")
    free, disposable = domain.isin(*FREEMAIL), domain.isin(*DISPOSABLE) | risky
    return {
        "email_local": local, "email_domain": domain, "is_freemail": as_int(free), "is_disposable": as_int(disposable), "is_custom_domain": as_int(~free & ~disposable), "risky_tld": as_int(risky),
        "domain_has_digits": as_int(F.split_part(domain, F.lit("."), F.lit(1)).rlike(r"\p{Nd}")), "domain_depth": F.regexp_count(domain, F.lit(r"\.")), "suspicious": as_int(F.lower(local).rlike("|".join(SUSPICIOUS))),
    }


def name_coherence(name: Column, local: Column) -> Column:
    """Least edit distance between an address's local part and a part of the name (parted by blanks and dashes), over the local
    part's length; a name without parts counts as NO_NAME away."""
    parts = F.filter(F.split(F.translate(F.lower(name), "-", " "), r"\s+"), lambda p: p != "")
    least = F.array_min(F.transform(parts, lambda p: F.levenshtein(F.lower(local), p).cast("double")))
    return F.when(name.isNotNull(), F.coalesce(least, F.lit(NO_NAME)) / F.greatest(F.length(local), F.lit(1)))


def name_in_email(name: Column, local: Column) -> Column:
    """1 if a part of the name (parted by blanks) stands in the local part."""
    parts = F.filter(F.split(F.lower(name), r"\s+"), lambda p: p != "")
    return as_int(F.exists(parts, lambda p: F.contains(F.lower(local), p)))


def sanitized(s: Column, longest: int = 40) -> Column:
    """Safe for names of folders: letters, digits, `-`, `_` and blanks stay, outer blanks go, inner ones become `_`; at most
    `longest` characters, none of them `_` at the end; lower case."""
    kept = F.translate(F.btrim(F.regexp_replace(s, r"[^\p{L}\p{N}_ -]", "")), " ", "_")
    return F.lower(F.rtrim(F.substring(kept, 1, longest), F.lit("_")))


def content_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 16)


def tags(s: Column, keywords: dict[str, tuple[str, ...]], fallback: str = "other") -> Column:
    """Names of all categories of which a keyword occurs; the fallback if there are none."""
    low = F.lower(s)
    found = F.filter(F.array(*(F.when(low.rlike("|".join(map(_quote, words))), F.lit(name)) for name, words in keywords.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback)))


def _quote(word: str) -> str:
    import re

    return re.escape(word.lower())


def campaign(s: Column) -> Column:
    """(name, step, steps) of texts like `name campaign step 2/5`; nulls where there is none."""
    pattern = r"(?i)([\w-]+)\s*campaign\s+step\s*(\d+)\s*(?:/|of)\s*(\d+)"
    part = lambda i: F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))
    return F.struct(part(1).alias("name"), part(2).cast("int").alias("step"), part(3).cast("int").alias("steps"))
