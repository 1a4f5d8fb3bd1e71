"""Column functions on annotation texts, rules and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes of annotation attributes, in the order in which they are undone.
ESCAPES = (("%09", "\t"), ("%0A", "\n"), ("%0D", "\r"), ("%3B", ";"), ("%3D", "="), ("%26", "&"), ("%2C", ","), ("%25", "%"))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once however often f uses it: a lambda's variable is."""
    return F.element_at(F.transform(F.array(x), f), 1)


def gff_unescape(s: Column) -> Column:
    for code, char in ESCAPES:
        s = F.replace(s, F.lit(code), F.lit(char))
    return s


def gff_escape(s: Column) -> Column:
    for code, char in reversed(ESCAPES):
        s = F.replace(s, F.lit(char), F.lit(code))
    return s


def token_eq(col: Column, value: str) -> Column:
    """If one of the values joined by ^ is this one."""
    return F.array_contains(F.split(col, r"\^"), value)


def compact_pvalue(p: Column) -> Column:
    """A p-value as two digits and an exponent, such as 35e-6; null and 0 as they are."""
    e = F.floor(F.log10(p)).cast("int") - 1
    power = F.concat(F.lit("1e"), e.cast("string")).cast("double")  # the double nearest to it; pow() can be the one beside, and digits on a half then fall otherwise
    return F.when(p.isNull(), None).when(p <= 0, F.lit("0")).otherwise(F.format_string("%de%d", F.round(p / power).cast("int"), e))


def rule_matches(value: Column, mode: str, wanted) -> Column:
    """The match modes of colour rules; "has" ignores case."""
    text = value.cast("string")
    number = text.try_cast("double")
    modes = {
        "exact": lambda: text == str(wanted),
        "not_equal": lambda: text != str(wanted),
        "has": lambda: F.contains(F.lower(text), F.lit(str(wanted).lower())),
        "has_not": lambda: ~F.contains(F.lower(text), F.lit(str(wanted).lower())),
        "lt": lambda: number < float(wanted),
        "gt": lambda: number > float(wanted),
        "random": lambda: text.isNotNull(),
    }
    return F.coalesce(modes[mode](), F.lit(False))


def rule_color(qualifiers: Column, rules: list[dict]) -> Column:
    """The colour of the first rule that matches; rules have key, mode, value, color. "random": from a hash of the value."""
    out = []
    for rule in rules:
        value = F.try_element_at(qualifiers, F.lit(rule["key"]))
        color = F.concat(F.lit("#"), F.substring(F.sha2(value, 256), 1, 6)) if rule["mode"] == "random" else F.lit(rule["color"])
        out.append(F.when(rule_matches(value, rule["mode"], rule.get("value")), color))
    return F.coalesce(*out, F.lit(None).cast("string"))


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    """A map with some keys under their usual name; the usual name wins where both are there."""
    def renamed(m: Column) -> Column:
        usual = F.map_filter(m, lambda k, _: ~k.isin(list(names)))
        entries = [F.when(F.map_contains_key(m, old) & ~F.map_contains_key(m, new), F.create_map(F.lit(new), F.element_at(m, F.lit(old)))).otherwise(F.create_map().cast("map<string,string>")) for old, new in names.items()]
        return F.map_concat(usual, *entries)

    return once(m, renamed)
