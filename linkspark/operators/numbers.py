"""Number features of two addresses: what their digits, the text around them and the order of them say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batch, similarity, text

# ---- Fixed values ----
UNITS = "unit|suite|ste|apt|apartment|floor|fl|bldg|building|room|rm|plot|flat"
FEATURES = (
    "nf_count1 nf_count2 nf_first_missing1 nf_first_missing2 nf_digit_lev nf_digit_damerau nf_digit_norm nf_len_diff nf_single_sub nf_single_indel nf_transposition nf_zero_equal "
    "nf_substring nf_shared_prefix nf_shared_suffix nf_firstpos1 nf_firstpos2 nf_startsnum1 nf_startsnum2 nf_unit_before1 nf_unit_before2 nf_compound1 nf_compound2 nf_rest_equal "
    "nf_multiset_equal nf_order_changed nf_shared_count nf_first_in_other nf_other_first_in_self nf_alpha_ratio nf_alpha_tset nf_alpha_equal nf_alpha_lenratio nf_num_only1 nf_num_only2"
).split()
# ---- End of fixed values ----


def parse(address: Column) -> dict[str, Column]:
    """The numbers of an address as written, its letters, where the first number begins (-1: none), whether the text begins with it, a unit word stands before it, a letter touches it."""
    s = F.lower(text.compatible(F.coalesce(address, F.lit(""))))
    numbers = F.regexp_extract_all(s, F.lit(r"([0-9]+)"), F.lit(1))
    at = F.regexp_instr(s, F.lit("[0-9]")) - 1
    before = F.substring(s, F.lit(1), F.greatest(at, F.lit(0)))
    some = F.size(numbers) > 0
    letters = F.regexp_replace(F.regexp_replace(s, "[0-9]+", " "), r"[^\p{L}\p{M}\p{N}_\s]", " ")
    return {
        "numbers": numbers, "letters": F.trim(F.regexp_replace(letters, r"\s+", " ")), "at": at, "starts": some & (F.trim(before) == ""),
        "unit": some & before.rlike(rf"\b(?:{UNITS})\b"), "compound": some & (before.rlike(r"\p{L}$") | s.rlike(r"^[^0-9]*[0-9]+\p{L}")),
    }


def _common_head(x: Column, y: Column) -> Column:
    """Length of the longest common prefix."""
    most = F.least(F.length(x), F.length(y))
    return F.size(F.filter(F.sequence(F.lit(0), most), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))) - 1


def pair(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """FEATURES of two parsed addresses, as doubles; -1 where a side has no number (or, for the text, no letters)."""
    na, nb = a["numbers"], b["numbers"]
    x, y = F.coalesce(F.try_element_at(na, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(nb, F.lit(1)), F.lit(""))
    both, letters = (F.size(na) > 0) & (F.size(nb) > 0), (a["letters"] != "") & (b["letters"] != "")
    lev, dam = F.levenshtein(x, y), similarity.column(similarity.damerau, "int")(x, y)
    bare = lambda v: F.regexp_replace(v, "^0+(?=[0-9])", "")
    tail = lambda v: F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    more = (F.size(na) > 1) & (F.size(nb) > 1)
    same = F.array_sort(na) == F.array_sort(nb)
    ordered, distinct = zip(*(batch.token_views(p["letters"]) for p in (a, b)))
    shared, only_a, only_b = batch.set_parts(*distinct)
    values = {
        "nf_digit_lev": lev, "nf_digit_damerau": dam, "nf_digit_norm": lev / F.greatest(F.length(x), F.length(y), F.lit(1)), "nf_len_diff": F.length(y) - F.length(x),
        "nf_single_sub": (lev == 1) & (F.length(x) == F.length(y)), "nf_single_indel": (lev == 1) & (F.length(x) != F.length(y)), "nf_transposition": (dam == 1) & (lev == 2),
        "nf_zero_equal": bare(x) == bare(y), "nf_substring": y.contains(x) | x.contains(y), "nf_shared_prefix": _common_head(x, y), "nf_shared_suffix": _common_head(F.reverse(x), F.reverse(y)),
        "nf_rest_equal": F.when(more, (tail(na) == tail(nb)).cast("int")).otherwise(-1), "nf_multiset_equal": same, "nf_order_changed": same & (na != nb),
        "nf_shared_count": F.size(F.array_intersect(na, nb)), "nf_first_in_other": F.array_contains(nb, x), "nf_other_first_in_self": F.array_contains(na, y),
    }
    out = {k: F.when(both, c.cast("double")).otherwise(-1.0) for k, c in values.items()}
    lengths = F.least(F.length(a["letters"]), F.length(b["letters"])) / F.greatest(F.length(a["letters"]), F.length(b["letters"]), F.lit(1))
    rest = batch.column("ratio")(only_a, only_b)
    of_text = {
        "nf_alpha_ratio": batch.column("ratio")(a["letters"], b["letters"]) / 100, "nf_alpha_tset": batch.token_set(shared, only_a, only_b, rest, ~letters) / 100,
        "nf_alpha_equal": (a["letters"] == b["letters"]).cast("double"), "nf_alpha_lenratio": lengths,
    }
    out |= {k: F.when(letters, c.cast("double")).otherwise(-1.0) for k, c in of_text.items()}
    for i, p in ((1, a), (2, b)):
        none = F.size(p["numbers"]) == 0
        out |= {f"nf_count{i}": F.size(p["numbers"]), f"nf_first_missing{i}": none, f"nf_firstpos{i}": p["at"], f"nf_startsnum{i}": p["starts"], f"nf_unit_before{i}": p["unit"],
                f"nf_compound{i}": p["compound"], f"nf_num_only{i}": ~none & (p["letters"] == "")}
    return {k: out[k].cast("double") for k in FEATURES}


def number_features(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """The kept columns and FEATURES of the address columns a and b. Addresses are parsed in a projection of their own: what compares them runs over the parsed columns."""
    parsed = {t: parse(F.col(c)) for t, c in (("a", a), ("b", b))}
    x = df.select(*keep, *[c.alias(f"_{t}_{k}") for t, p in parsed.items() for k, c in p.items()])
    found = pair(*({k: F.col(f"_{t}_{k}") for k in p} for t, p in parsed.items()))
    return x.select(*keep, *[c.alias(k) for k, c in found.items()])
