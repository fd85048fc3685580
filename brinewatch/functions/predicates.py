"""Column functions: parsing, normalising, masking, hashing, and checks of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What actions are called in the canonical schema, and which ones are of high impact.
ACTION_NAMES = {"view": "read", "click": "invoke", "purchase": "assume_role", "signup": "create_user", "error": "access_denied"}
HIGH_IMPACT = ("assume_role", "create_user", "delete_user", "attach_policy", "detach_policy", "create_access_key", "deactivate_mfa", "delete_trail")
# What injected text looks like.
INJECTIONS = ("ignore previous", "disregard", "<script", "drop table", "union select", "../", "$(", "system prompt")


def first_valid(*fields: Column, least: int = 2, default: str = "unknown") -> Column:
    """The first field whose trimmed text has at least some characters."""
    return F.coalesce(*(F.when(F.length(F.trim(f)) >= least, F.trim(f)) for f in fields), F.lit(default))


def renamed(action: Column, names: dict[str, str]) -> Column:
    """The canonical name of an action, or the action itself."""
    out = action
    for old, new in names.items():
        out = F.when(action == old, new).otherwise(out)
    return out


def actor_kind(actor: Column) -> Column:
    """By the first sign that fits: service words, role words, an address, else a machine."""
    a = F.lower(actor)
    has = lambda *words: reduce(lambda x, y: x | y, (a.contains(w) for w in words))
    return F.when(has("service", "lambda", "bot"), "service").when(has("role", "assumed"), "role").when(a.contains("@"), "user").otherwise("machine")


def severity(explicit: Column, action: Column) -> Column:
    """Given, else high for actions of high impact, else info."""
    return F.coalesce(F.lower(explicit), F.when(action.isin(*HIGH_IMPACT), "high").otherwise("info"))


def tags(**conditions: Column) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def short_method(name: Column) -> Column:
    """The last part after dots and slashes."""
    return F.element_at(F.split(F.element_at(F.split(name, r"\."), -1), "/"), -1)


def masked(token: Column) -> Column:
    return F.when(F.length(token) <= 8, "****").otherwise(F.concat(F.substring(token, 1, 4), F.lit("****"), F.substring(token, -4, 4)))


def content_hash(*fields: Column, length: int = 20) -> Column:
    """The first characters of the sha256 of fields joined by colons; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256), 1, length)


def first_failure(**checks: Column) -> Column:
    """The name of the first check that doesn't hold (null counts as failed), or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def ipv4(ip: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    p = F.split(ip, r"\.")
    part = [F.try_element_at(p, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    ok = (F.size(p) == 4) & reduce(lambda a, b: a & b, (x.between(0, 255) for x in part))
    return F.when(F.coalesce(ok, F.lit(False)), part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def in_cidr(ip: Column, network: Column, bits: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    return F.coalesce(F.floor(ipv4(ip) / size) == F.floor(ipv4(network) / size), F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (a UUID's text): SHA-1, with the version and variant set."""
    h = F.sha1(F.concat(F.lit(bytearray.fromhex(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda s, n: F.substring(h, s, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def titled(text: Column) -> Column:
    """Words with a capital first letter, the rest small."""
    return F.initcap(F.lower(text))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty one."""
    chars = F.split(text, "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(text == "", 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))
