"""Nucleotide sequences, qualities and read names as Column functions; null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nucleotide codes and their complements (U pairs like T).
CODES, COMPLEMENTS = "ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"
#: Which of A, C, G, T (bits 1, 2, 4, 8) each code stands for; a gap stands for none.
BASES = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15, "-": 0,
}
#: Published nearest-neighbour sets, as (enthalpy kcal/mol, entropy cal/mol K): a start term, terms for a
#: sequence with any G or C and without, for each A/T and G/C end, and for the ten 2-mers (their complements alike).
NEIGHBOURS = {
    "breslauer1986": {
        "start": (0, 0), "any_gc": (0, -16.8), "no_gc": (0, -20.1), "end_at": (0, 0), "end_gc": (0, 0), "AA": (-9.1, -24.0), "AT": (-8.6, -23.9), "TA": (-6.0, -16.9),
        "CA": (-5.8, -12.9), "GT": (-6.5, -17.3), "CT": (-7.8, -20.8), "GA": (-5.6, -13.5), "CG": (-11.9, -27.8), "GC": (-11.1, -26.7), "GG": (-11.0, -26.6),
    },
    "sugimoto1996": {
        "start": (0.6, -9.0), "any_gc": (0, 0), "no_gc": (0, 0), "end_at": (0, 0), "end_gc": (0, 0), "AA": (-8.0, -21.9), "AT": (-5.6, -15.2), "TA": (-6.6, -18.4),
        "CA": (-8.2, -21.0), "GT": (-9.4, -25.5), "CT": (-6.6, -16.4), "GA": (-8.8, -23.5), "CG": (-11.8, -29.0), "GC": (-10.5, -26.4), "GG": (-10.9, -28.4),
    },
    "santalucia1997": {
        "start": (0, 0), "any_gc": (0, 0), "no_gc": (0, 0), "end_at": (2.3, 4.1), "end_gc": (0.1, -2.8), "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
        "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
    },
    "santalucia2004": {
        "start": (0.2, -5.7), "any_gc": (0, 0), "no_gc": (0, 0), "end_at": (2.2, 6.9), "end_gc": (0, 0), "AA": (-7.6, -21.3), "AT": (-7.2, -20.4), "TA": (-7.2, -20.4),
        "CA": (-8.5, -22.7), "GT": (-8.4, -22.4), "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.0),
    },
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(c: Column | str) -> Column:
    """The characters as an array; empty for an empty string."""
    c = _col(c)
    return F.when(F.length(c) > 0, F.split(c, "")).when(c.isNotNull(), F.array().cast("array<string>"))


def let(values: dict[str, Column], body) -> Column:
    """`body` over a struct of values that are computed once; within higher-order functions Spark repeats shared parts."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def mask(code: Column) -> Column:
    """The set of nucleotides that one code stands for, as 4 bits; 0 for anything else."""
    pairs = [F.lit(x) for kv in BASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(code)), F.lit(0))


def codes_match(a: Column, b: Column) -> Column:
    """Equal codes match, and codes whose sets of nucleotides meet; a gap matches only a gap."""
    return (a == b) | (~both_plain(a, b) & (mask(a).bitwiseAND(mask(b)) != 0))


def both_plain(a: Column, b: Column) -> Column:
    """Whether each is one of A, C, G and T, which match only themselves: the sets need looking up only for others."""
    return a.isin(*"ACGT") & b.isin(*"ACGT")


def complement(c: Column | str) -> Column:
    """Each code replaced by its complement; other characters stay."""
    return F.translate(_col(c), CODES, COMPLEMENTS)


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(complement(c))


def orientations(c: Column | str) -> Column:
    """The four orientations as an array of (orientation, sequence)."""
    c = _col(c)
    ways = {"FWD": c, "RVS": F.reverse(c), "RVS_CMP": reverse_complement(c), "CMP": complement(c)}
    return F.array(*[F.struct(F.lit(k).alias("orientation"), v.alias("sequence")) for k, v in ways.items()])


def sub_sequence(c: Column | str, start: Column | int, end: Column | int) -> Column:
    """From start to end, both 0-based and included; an end past the sequence is its last code."""
    c, start, end = _col(c), F.lit(start), F.lit(end)
    return F.substring(c, start + 1, F.greatest(F.lit(0), F.least(end, F.length(c) - 1) - start + 1))


def gc_percent(c: Column | str) -> Column:
    """Percentage of codes that can be G or C; null for an empty sequence."""
    c = _col(c)
    gc = "".join(k for k, v in BASES.items() if v & 6)
    return F.try_divide(100.0 * F.regexp_count(F.upper(c), F.lit(f"[{gc}]")), F.length(c))


def base_counts(c: Column | str) -> Column:
    """Struct a, c, g, t: each code counts for the first nucleotide that it can be."""
    c, out, taken = F.upper(_col(c)), [], 0
    for name, bit in (("a", 1), ("c", 2), ("g", 4), ("t", 8)):
        codes = "".join(k for k, v in BASES.items() if v & bit and not v & taken)
        out.append(F.regexp_count(c, F.lit(f"[{codes}]")).alias(name))
        taken |= bit
    return F.struct(*out)


def melting_wallace(c: Column | str) -> Column:
    """2 (A + T) + 4 (G + C) degrees."""
    n = base_counts(c)
    return 2 * (n["a"] + n["t"]) + 4 * (n["g"] + n["c"])


def melting_gc(c: Column | str) -> Column:
    """64.9 + 41 (G + C - 16.4) / N degrees; null for an empty sequence."""
    n = base_counts(c)
    return F.try_divide(41 * (n["g"] + n["c"] - 16.4), F.length(_col(c))) + 64.9


def melting_neighbour(c: Column | str, *, source: str = "santalucia1997", oligo: float = 25.0, salt: float = 50.0) -> Column:
    """Nearest-neighbour melting temperature in degrees; null for sequences of fewer than 2 codes.

    Terms of all overlapping 2-mers add up (2-mers with codes other than A, C, G, T add nothing), with those of
    both ends and of the whole. oligo in nM, salt in mM, both as in the published formula.
    """
    terms = NEIGHBOURS[source]
    flip = {"A": "T", "C": "G", "G": "C", "T": "A"}
    c = F.upper(_col(c))

    def total(i: int) -> Column:
        table = {k: float(v[i]) for k, v in terms.items() if len(k) == 2}
        table |= {flip[k[1]] + flip[k[0]]: v for k, v in table.items()}
        weight = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        steps = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda p: F.coalesce(F.element_at(weight, F.substring(c, p, F.lit(2))), F.lit(0.0)))
        ends = sum((F.when(F.substring(c, p, 1).isin("A", "T"), float(terms["end_at"][i])).otherwise(float(terms["end_gc"][i])) for p in (1, -1)), F.lit(float(terms["start"][i])))
        whole = F.when(c.rlike("[GC]"), float(terms["any_gc"][i])).otherwise(float(terms["no_gc"][i]))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) + ends + whole

    enthalpy, entropy = total(0), total(1) + 0.368 * (F.length(c) - 1) * math.log(salt / 1e3)
    return F.when(F.length(c) > 1, 1000 * enthalpy / (entropy + 1.9872 * math.log(oligo / 4 * 1e-9)) - 273.15)


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Positions of the shorter length where the codes don't match."""
    a, b = chars(a), chars(b)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: codes_match(x, y))
    return F.size(F.filter(pairs, lambda m: ~m))


def _places(text: Column, query: Column, most: int, same) -> Column:
    """1-based starts where the query's items stand in the text's with at most `most` that `same` denies."""
    n, m = F.size(text), F.size(query)

    def fits(start: Column) -> Column:
        return F.size(F.filter(F.zip_with(F.slice(text, start, m), query, same), lambda ok: ~ok)) <= most

    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull() & query.isNotNull(), F.filter(starts, fits))


def approximate_matches(text: Column | str, query: Column | str, most: int, *, first: int | None = None) -> Column:
    """1-based start positions (the `first` ones only, if asked) where the query fits with at most `most` mismatches; any codes, by their sets."""
    found = _places(F.transform(chars(text), mask), F.transform(chars(query), mask), most, lambda x, y: x.bitwiseAND(y) != 0)
    return found if first is None else F.slice(found, 1, first)


def first_match(text: Column | str, query: Column | str, most: int) -> Column:
    """The first of `approximate_matches`; null if there is none."""
    return F.get(approximate_matches(text, query, most, first=1), F.lit(0))


def has_match(text: Column | str, query: Column | str, most: int) -> Column:
    """Whether `approximate_matches` has any; an empty query is nowhere."""
    return F.size(approximate_matches(text, query, most, first=1)) > 0


def contains_within(text: Column | str, query: Column | str, most: int) -> Column:
    """Whether a plain string stands in another with at most `most` other characters; an empty one does."""
    return F.when(F.length(_col(query)) == 0, text_present(text)).otherwise(F.size(_places(chars(text), chars(query), most, lambda x, y: x == y)) > 0)


def text_present(text: Column | str) -> Column:
    """True, null for null."""
    return F.when(_col(text).isNotNull(), F.lit(True))


def kmers(c: Column | str, k: int, *, last: bool = True) -> Column:
    """All k-mers as an array of (pos, kmer), pos 0-based; `last=False` leaves out the last one."""
    c = _col(c)
    end = F.length(c) - k + (0 if last else -1)
    return F.when(end >= 0, F.transform(F.sequence(F.lit(0), end), lambda p: F.struct(p.alias("pos"), F.substring(c, p + 1, F.lit(k)).alias("kmer")))).otherwise(
        F.array().cast("array<struct<pos:int,kmer:string>>")
    )


def kmer_number(c: Column | str) -> Column:
    """A k-mer (k up to 31) as a base-4 number, A=0 C=1 G=2 T=3; null with any other code."""
    c = F.upper(_col(c))
    return F.when(c.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("long"))


def phred(c: Column) -> Column:
    """The quality of one character."""
    return F.ascii(c) - 33


def quality_total(c: Column | str) -> Column:
    """Sum of the qualities of a string's characters."""
    return F.aggregate(chars(c), F.lit(0).cast("long"), lambda a, x: a + phred(x))


def quality_trim(seq: Column | str, qual: Column | str, leading: int, trailing: int) -> Column:
    """Struct seq, qual without leading bases below `leading` and, after that, trailing ones below `trailing`."""
    seq, qual = _col(seq), _col(qual)

    def below(t: int) -> str:
        return "[" + "".join(f"\\x{{{c:x}}}" for c in range(33, max(33, min(127, 33 + t)))) + "]"

    first = F.length(F.regexp_extract(qual, f"^{below(leading)}*", 0)) if leading > 0 else F.lit(0)
    rest = F.substring(qual, first + 1, F.length(qual))
    last = F.length(F.regexp_extract(rest, f"{below(trailing)}*$", 0)) if trailing > 0 else F.lit(0)
    keep = F.length(rest) - last
    return F.struct(F.substring(seq, first + 1, keep).alias("seq"), F.substring(qual, first + 1, keep).alias("qual"))


def fixed_trim(seq: Column | str, qual: Column | str, first: int, last: int, three_prime: bool = True) -> Column:
    """Struct seq, qual of positions first to last (0-based, included); without `three_prime` the tail stays.

    An error where first lies past the read or sequence and quality differ in length.
    """
    seq, qual = _col(seq), _col(qual)
    n = F.length(seq)
    keep = (F.least(F.lit(last), n - 1) if three_prime else n - 1) - first + 1
    cut = F.struct(F.substring(seq, F.lit(first + 1), keep).alias("seq"), F.substring(qual, F.lit(first + 1), keep).alias("qual"))
    wrong = (n <= first) | (n != F.length(qual))
    return F.when(wrong, F.raise_error(F.lit("cannot trim: read too short, or sequence and quality differ in length"))).otherwise(cut)


def has_n(c: Column | str) -> Column:
    """Whether a read holds an undetermined base."""
    return F.lower(_col(c)).contains("n")


def uid(c: Column | str, length: int) -> Column:
    """The molecular barcode: the first `length` bases of a read."""
    return F.substring(_col(c), 1, length)


def merge_pair(negative: Column, up: Column, down: Column, up_qual: Column, down_qual: Column, up_start: Column, down_start: Column) -> Column:
    """One sequence of two mates, as struct seq, qual.

    `up` starts at or before `down`. Where both cover a base the better quality wins, ties go to `up`; a hole
    between them is N with the worst quality. On the negative strand the result is reverse-complemented.
    """
    mates = {"neg": negative, "u": up, "d": down, "uq": up_qual, "dq": down_qual, "shift": down_start - up_start}
    lengths = lambda x: {"x": x, "un": F.length(x["u"]), "dn": F.length(x["d"])}
    shared = lambda y: {
        "y": y, "over": F.greatest(F.lit(0), F.least(y["un"] - y["x"]["shift"], y["dn"])), "hole": F.greatest(F.lit(0), y["x"]["shift"] - y["un"]),
    }

    def better(z: Column) -> Column:
        """The overlap's positions, each as the better mate's quality and base."""
        x, over = z["y"]["x"], z["over"]

        def tokens(seq: Column, qual: Column, start: Column) -> Column:
            return F.zip_with(chars(F.substring(qual, start, over)), chars(F.substring(seq, start, over)), lambda q, b: F.concat(q, b))

        up_side, down_side = tokens(x["u"], x["uq"], x["shift"] + 1), tokens(x["d"], x["dq"], F.lit(1))
        return F.zip_with(up_side, down_side, lambda a, b: F.when(F.ascii(a) >= F.ascii(b), a).otherwise(b))

    def whole(w: Column) -> Column:
        z, y, x = w["z"], w["z"]["y"], w["z"]["y"]["x"]

        def parts(a: Column, b: Column, fill: str, at: int) -> Column:
            mid = F.array_join(F.transform(w["best"], lambda t: F.substring(t, at, 1)), "")
            head = F.substring(a, F.lit(1), F.least(y["un"], x["shift"]))
            tail = F.when(y["dn"] > z["over"], F.substring(b, z["over"] + 1, y["dn"])).otherwise(F.substring(a, x["shift"] + z["over"] + 1, y["un"]))
            return F.concat(head, F.when(z["hole"] > 0, F.repeat(F.lit(fill), z["hole"])).otherwise(mid), tail)

        return F.struct(parts(x["u"], x["d"], "N", 2).alias("seq"), parts(x["uq"], x["dq"], "!", 1).alias("qual"), x["neg"].alias("neg"))

    def turned(m: Column) -> Column:
        back = m["neg"]
        return F.struct(F.when(back, reverse_complement(m["seq"])).otherwise(m["seq"]).alias("seq"), F.when(back, F.reverse(m["qual"])).otherwise(m["qual"]).alias("qual"))

    def merged(x: Column) -> Column:
        return let(lengths(x), lambda y: let(shared(y), lambda z: let({"z": z, "best": better(z)}, whole)))

    return let({"m": let(mates, merged)}, lambda v: turned(v["m"]))
