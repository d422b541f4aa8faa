"""Sequence scalars as Column expressions: complement, translation, composition, fingerprints, qualities, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Each IUPAC symbol and its complement.
IUPAC = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
IUPAC_COMPLEMENT = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"

# Genetic codes by number: name, amino acids and start codons of the 64 codons in the order TCAG.
GENETIC_CODES = {
    1: ("Standard", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M---------------M---------------M----------------------------"),
    2: ("Vertebrate Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", "--------------------------------MMMM---------------M------------"),
    3: ("Yeast Mitochondrial", "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "----------------------------------MM----------------------------"),
    4: ("Mold Mitochondrial; Protozoan Mitochondrial; Coelenterate Mitochondrial; Mycoplasma; Spiroplasma", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--MM---------------M------------MMMM---------------M------------"),
    5: ("Invertebrate Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", "---M----------------------------MMMM---------------M------------"),
    6: ("Ciliate Nuclear; Dasycladacean Nuclear; Hexamita Nuclear", "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "-----------------------------------M----------------------------"),
    9: ("Echinoderm Mitochondrial; Flatworm Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "-----------------------------------M---------------M------------"),
    10: ("Euplotid Nuclear", "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "-----------------------------------M----------------------------"),
    11: ("Bacterial, Archaeal and Plant Plastid", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M---------------M------------MMMM---------------M------------"),
    12: ("Alternative Yeast Nuclear", "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "-------------------M---------------M----------------------------"),
    13: ("Ascidian Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG", "---M------------------------------MM---------------M------------"),
    14: ("Alternative Flatworm Mitochondrial", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "-----------------------------------M----------------------------"),
    15: ("Blepharisma Macronuclear", "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "-----------------------------------M----------------------------"),
    16: ("Chlorophycean Mitochondrial", "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "-----------------------------------M----------------------------"),
    21: ("Trematode Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "-----------------------------------M---------------M------------"),
    22: ("Scenedesmus obliquus Mitochondrial", "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "-----------------------------------M----------------------------"),
    23: ("Thraustochytrium Mitochondrial", "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "--------------------------------M--M---------------M------------"),
    24: ("Pterobranchia Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "---M---------------M---------------M---------------M------------"),
    25: ("Candidate Division SR1 and Gracilibacteria", "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "---M-------------------------------M---------------M------------"),
}


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_upper(x: C) -> Column:
    return F.translate(_c(x), _LOWER, _UPPER)


def ascii_lower(x: C) -> Column:
    return F.translate(_c(x), _UPPER, _LOWER)


def complement(x: C) -> Column:
    return F.translate(_c(x), IUPAC, IUPAC_COMPLEMENT)


def reverse_complement(x: C) -> Column:
    return F.reverse(complement(x))


def only_iupac(x: C) -> Column:
    """True where every symbol has a complement."""
    return _c(x).rlike(f"^[{IUPAC}]*$")


def composition(x: C, symbols: str) -> Column:
    """Number of positions that hold one of `symbols`."""
    return F.length(_c(x)) - F.length(F.translate(_c(x), symbols, ""))


def gc_content(x: C) -> Column:
    """Share of G and C among A, C, G and T."""
    gc, at = composition(x, "GCgc"), composition(x, "ATat")
    return F.when(gc + at > 0, gc / (gc + at))


def fingerprint(x: C) -> Column:
    """MD5 of the sequence in ASCII upper case."""
    return F.md5(ascii_upper(x).cast("binary"))


def codon_map(code: int = 1, starts: bool = False) -> dict[str, str]:
    symbols = GENETIC_CODES[code][2 if starts else 1]
    bases = "TCAG"
    return {a + b + c: symbols[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


#: Bases that each wildcard stands for.
WILDCARDS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def resolved_codons(code: int = 1) -> dict[str, str]:
    """Codons with wildcards too, where all readings give one amino acid."""
    plain = codon_map(code)
    letters = {b: b for b in "ACGT"} | WILDCARDS
    out = {}
    for a, x in letters.items():
        for b, y in letters.items():
            for c, z in letters.items():
                aas = {plain[p + q + r] for p in x for q in y for r in z}
                if len(aas) == 1:
                    out[a + b + c] = aas.pop()
    return out


def translate_dna(x: C, frame: int | Column = 0, code: int = 1, unknown: str = "X") -> Column:
    """Amino acids of a frame (0, 1, 2); incomplete last codons are left out, ambiguous ones are `unknown`.

    One pass cuts the sequence into codons of base digits; a codon's number picks its letter from
    a string of 64. Nothing in the loop over codons looks at the whole sequence again.
    """
    letters = F.lit("".join(codon_map(code)[a + b + c] for a in "TCAG" for b in "TCAG" for c in "TCAG"))
    digits = F.translate(ascii_upper(x), "TUCAG", "00123")
    codons = F.regexp_extract_all(F.substring(digits, F.lit(frame) + 1, F.length(_c(x))), F.lit("(?s)(.{3})"), F.lit(1))

    def one(d: Column) -> Column:
        at = F.ascii(d) * 16 + F.ascii(F.substring(d, 2, 1)) * 4 + F.ascii(F.substring(d, 3, 1)) - 48 * 21
        return F.when(d.rlike("^[0-3]{3}$"), F.substring(letters, at + 1, F.lit(1))).otherwise(F.lit(unknown))

    return F.array_join(F.transform(codons, one), "")


def kmers(x: C, k: int) -> Column:
    """Array of all k-long substrings, in order; empty for shorter sequences. A lookahead finds them in one pass."""
    return F.regexp_extract_all(_c(x), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def positions(x: C, pattern: C) -> Column:
    """All (overlapping) 1-based places of `pattern`, which may be a column."""
    n = F.length(_c(x)) - F.length(_c(pattern)) + 1
    return F.when((n > 0) & (F.length(_c(pattern)) > 0), F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(_c(x), i, F.length(_c(pattern))) == _c(pattern))).otherwise(F.array().cast("array<int>"))


def phred_scores(q: C, offset: int = 33) -> Column:
    """Quality values of an ASCII quality string; offset 33 is Phred, 64 Solexa."""
    return F.transform(F.split(_c(q), ""), lambda c: F.ascii(c) - offset)


def solexa_to_phred(s: C) -> Column:
    return 10 * F.log10(F.pow(F.lit(10.0), _c(s) / 10) + 1)


def error_probability(phred: C) -> Column:
    return F.pow(F.lit(10.0), -_c(phred) / 10)


def escape_gff3(x: C) -> Column:
    """Percent-encode what has a meaning in an attribute: % first, then ; = & , and control characters."""
    out = F.replace(_c(x), F.lit("%"), F.lit("%25"))
    for c in ";=&,\t\n\r":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def unescape_gff3(x: C) -> Column:
    """Percent-decode; a plus stays a plus."""
    return F.url_decode(F.replace(F.regexp_replace(_c(x), "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def wrap_fasta(x: C, width: int = 60) -> Column:
    return F.regexp_replace(_c(x), f"(.{{{width}}})(?=.)", "$1\n") if width else _c(x)
