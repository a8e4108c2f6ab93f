"""Actions on regions: replacement text of each region, the spliced text, and the reversal map."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.literals import mapping
from ..functions.spans import distinct
from ..policy import Policy

#: An action of the caller's own: the new text from the value and its entity.
Operator = Callable[[Column, Column], Column]
CHANGES = ("mask", "hash", "encrypt", "reversible_replace", "replace", "redact")


@dataclass(frozen=True)
class Keys:
    """Key material and the clock of a run; both are given, so a run can be repeated."""

    hash_key: bytes
    scope: str = "default"
    as_of: int = 0
    nonce_seed: str = "nonce"


def masked(value: Column, char: Column, most: Column, from_end: Column) -> Column:
    """Up to ``most`` characters replaced by ``char``, at the end or the start; 0 masks nothing."""
    n = F.least(most, F.length(value))
    stars = F.repeat(char, n)
    return F.when(from_end, F.concat(F.substr(value, F.lit(1), F.length(value) - n), stars)).otherwise(F.concat(stars, F.substr(value, n + 1)))


def cipher(keys: Keys, entity: Column, value: Column) -> Column:
    """AES-256-GCM of a value (Base64 of nonce, cipher text and tag), the entity bound in; the nonce is a keyed digest of both, so a run can be repeated."""
    key = F.lit(bytearray(hashlib.sha256(b"palimpsest:v1:cipher-key:" + keys.hash_key).digest()))
    iv = F.substring(F.unhex(digests.hmac_sha256(keys.hash_key, F.concat(F.lit("palimpsest:v1:cipher-nonce:"), entity, F.lit(":"), value))), 1, 12)
    return F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, entity.cast("binary")))


def deciphered(keys: Keys, entity: Column, text: Column) -> Column:
    """The value that ``cipher`` hid; null if the text or the entity was changed."""
    key = F.lit(bytearray(hashlib.sha256(b"palimpsest:v1:cipher-key:" + keys.hash_key).digest()))
    return F.try_aes_decrypt(F.unbase64(text), key, F.lit("GCM"), F.lit("DEFAULT"), entity.cast("binary")).cast("string")


def _params(policy: Policy, entity: Column) -> tuple[Column, Column, Column, Column]:
    """Mask character, count, side and replacement text of an entity."""
    out = []
    default = policy.default_operator
    for name in ("masking_char", "chars_to_mask", "from_end"):
        table = {e.entity_type: getattr(e, name) for e in policy.entity_policies}
        value = F.lit(getattr(default, name))
        out.append(F.coalesce(F.element_at(mapping(table), entity), value) if table else value)
    named = F.concat(F.lit("<"), entity, F.lit(">"))
    table = {e.entity_type: e.new_value or "<ENTITY>" for e in policy.entity_policies}
    fallback = F.lit(default.new_value) if default.new_value else named
    if table:
        given = F.element_at(mapping(table), entity)
        fallback = F.coalesce(F.replace(given, F.lit("<ENTITY>"), named), fallback)
    return out[0], out[1], out[2], fallback


def done(text: Column, regions: Column, policy: Policy, keys: Keys, nonce: Column, operators: Mapping[str, Operator] | None = None) -> Column:
    """What happens to each region: ``array<struct<start, end, entity_type, action, original, new, placeholder>>``.

    ``action`` is null where the text stays (pass, block, or a reroute that does not mask). ``operators`` take the place of
    built-in actions (mask, replace, redact, or the cipher of encrypt).
    """
    own = operators or {}

    def one(r: Column) -> Column:
        original = F.substr(text, r.start + 1, r.end - r.start)
        char, most, from_end, new_value = _params(policy, r.entity_type)
        acts = r.action.isin(*CHANGES) | ((r.action == "reroute") & F.lit(policy.mask_on_reroute))
        plug = lambda action, built_in: own[action](original, r.entity_type) if action in own else built_in
        reversible = digests.placeholder(keys.hash_key, "REV", nonce, r.entity_type, original)
        encrypted = digests.placeholder(keys.hash_key, "ENCRYPTED", nonce, r.entity_type, plug("encrypt", cipher(keys, r.entity_type, original)))
        hashed = digests.rolling_hash(keys.hash_key, keys.scope, r.entity_type, original, keys.as_of, policy.hash_window_hours)
        new = (
            F.when(~acts, original).when(r.action.isin("mask", "reroute"), plug("mask", masked(original, char, most, from_end))).when(r.action == "hash", hashed)
            .when(r.action == "reversible_replace", reversible).when(r.action == "encrypt", encrypted).when(r.action == "replace", plug("replace", new_value)).otherwise(plug("redact", F.lit("")))
        )
        mark = F.when(r.action.isin("reversible_replace", "encrypt"), new)
        return F.struct(
            r.start.alias("start"), r.end.alias("end"), r.entity_type.alias("entity_type"), F.when(acts, r.action).alias("action"),
            original.alias("original"), new.alias("new"), mark.alias("placeholder"),
        )

    return F.transform(regions, one)


def spliced(text: Column, edits: Column) -> Column:
    """The text with each edit in place of its region: gaps and replacements joined from left to right."""

    def piece(e: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(edits, i - 1).end)
        return F.concat(F.substr(text, before + 1, e.start - before), e.new)

    tail = F.substr(text, F.get(edits, F.size(edits) - 1).end + 1)
    return F.when(F.size(edits) == 0, text).otherwise(F.concat(F.array_join(F.transform(edits, piece), ""), tail))


def reversal(edits: Column) -> Column:
    """Distinct (placeholder, original) pairs of edits."""
    marked = F.filter(edits, lambda e: e.placeholder.isNotNull())
    return distinct(F.transform(marked, lambda e: F.struct(e.placeholder.alias("placeholder"), e.original.alias("original"))))


def conflicting(pairs: Column) -> Column:
    """Whether one placeholder stands for two values."""
    return F.size(pairs) != F.size(F.array_distinct(F.transform(pairs, lambda p: p.placeholder)))


def restored(text: Column, pairs: Column) -> Column:
    """The text with every placeholder put back."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p.placeholder, p.original))


def placeholders(text: Column) -> Column:
    """All placeholders in a text."""
    return F.regexp_extract_all(text, F.lit(r"<(?:REV|ENCRYPTED)_[A-Z0-9_]+_[0-9a-f]{16}_[0-9a-f]{16}>"), F.lit(0))
