"""Sequence functions as Columns. Sequences are ASCII; other letters than ACGT and acgt keep their value in a complement."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Fixed value: the standard genetic code in the order T, C, A, G of each codon position.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def canonical(seq: Column | str) -> Column:
    """The lower of a sequence and its reverse complement in byte order."""
    return F.least(_col(seq), reverse_complement(seq))


def is_flipped(seq: Column | str) -> Column:
    return canonical(seq) != _col(seq)


def window(seq: Column | str, start: Column, size: int) -> Column:
    """size letters from the 0-based start, in constant time for a sequence of any length."""
    return F.substring(_col(seq).cast("binary"), start + 1, F.lit(size)).cast("string")


def fraction_gc(seq: Column | str) -> Column:
    s = F.upper(_col(seq))
    return (F.length(s) - F.length(F.translate(s, "GC", ""))) / F.nullif(F.length(s), F.lit(0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places that differ; null for unlike lengths."""
    n = F.length(_col(a))
    differ = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(F.substr(_col(a), i, F.lit(1)) != F.substr(_col(b), i, F.lit(1)), 1).otherwise(0))
    return F.when(n == F.length(_col(b)), F.when(n == 0, F.lit(0)).otherwise(differ))


def truncate(seq: Column | str, keep: int = 3) -> Column:
    s = _col(seq)
    return F.concat(F.left(s, F.length(s) - keep), F.lit("..."), F.right(s, F.lit(keep)))


def is_valid(seq: Column | str) -> Column:
    return _col(seq).rlike("^[ACGTacgt]*$")


def neighbours(seq: Column | str, k: int) -> Column:
    """All sequences at one substitution of a k-letter sequence, sorted."""
    s = _col(seq)
    made = [F.concat(F.substr(s, F.lit(1), F.lit(i)), F.lit(b), F.substr(s, F.lit(i + 2))) for i in range(k) for b in BASES]
    return F.array_sort(F.array_remove(F.array_distinct(F.array(*made)), s))


def code_hash(seq: Column | str) -> Column:
    """The 32-bit polynomial hash of base 31 that Java gives a string."""
    s = _col(seq)
    total = F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def pack(kmer: Column | str) -> Column:
    """2 bits a base, right aligned, for at most 31 letters."""
    digits = F.split(F.translate(_col(kmer), BASES, "0123"), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: acc * 4 + c.cast("long"))


def unpack(packed: Column, k: int) -> Column:
    return F.concat(*[F.substr(F.lit(BASES), (F.shiftright(packed, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)])


def kmer_words(k: int) -> int:
    return -(-k // 32)


def translate_cds(seq: Column | str) -> Column:
    """Amino acids of the whole codons; a codon with another letter than ACGT gives N."""
    s = F.upper(_col(seq))
    order = "TCAG"
    table = F.create_map(*[F.lit(x) for i, a in enumerate(CODE) for x in (order[i // 16] + order[i // 4 % 4] + order[i % 4], a)])
    codons = F.transform(F.when(F.length(s) >= 3, F.sequence(F.lit(0), F.floor(F.length(s) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.element_at(table, F.substr(s, i * 3 + 1, F.lit(3))), F.lit("N")))
    return F.array_join(codons, "")


def trim_alleles(a: Column, b: Column) -> Column:
    """Struct (start, a, b): the common prefix and then the common suffix off."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(acc))
    ra, rb = F.reverse(a), F.reverse(b)
    back = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n - same) & (F.substr(ra, i, F.lit(1)) == F.substr(rb, i, F.lit(1))), i).otherwise(acc))
    return F.struct(same.alias("start"), F.substr(a, same + 1, F.length(a) - same - back).alias("a"), F.substr(b, same + 1, F.length(b) - same - back).alias("b"))


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNP").when(r == a, "MNP").when(r > a, "DEL").otherwise("INS")


def breakend(alt: Column) -> Column:
    """The chr:position that a breakend allele points to."""
    return F.regexp_extract(alt, r"[\[\]]([^\[\]]+)[\[\]]", 1)


def jaccard_percent(a: Column, b: Column) -> Column:
    return 100.0 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def second_neighbours(seq: Column | str, k: int) -> Column:
    """All sequences at exactly two substitutions of a k-letter sequence, sorted."""
    s = _col(seq)
    made = [F.concat(F.substr(s, F.lit(1), F.lit(i)), F.lit(a), F.substr(s, F.lit(i + 2), F.lit(j - i - 1)), F.lit(b), F.substr(s, F.lit(j + 2))) for i in range(k) for j in range(i + 1, k) for a in BASES for b in BASES]
    return F.array_sort(F.filter(F.array_distinct(F.array(*made)), lambda x: hamming(x, s) == 2))


def longest_common_substring(a: Column | str, b: Column | str) -> Column:
    """The first longest stretch of a that is in b: lengths grow at each start, so each start asks only for a longer one."""
    x, y = _col(a), _col(b)

    def step(acc: Column, i: Column) -> Column:
        sizes = F.sequence(F.length(acc) + 1, F.greatest(F.length(x) - i + 1, F.length(acc) + 1))
        grown = F.aggregate(sizes, acc, lambda best, n: F.when((F.length(best) >= n - 1) & (i + n - 1 <= F.length(x)) & F.contains(y, F.substr(x, i, n)), F.substr(x, i, n)).otherwise(best))
        return grown

    return F.when(F.length(x) == 0, "").otherwise(F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(""), step))


def splits(seq: Column | str, letters: str) -> Column:
    """The sequence in stretches of these letters and stretches of others, in order."""
    return F.regexp_extract_all(_col(seq), F.lit(f"([{letters}]+|[^{letters}]+)"), 1)


def edits(a: Column | str, b: Column | str) -> Column:
    """Columns of an aligned pair of texts that differ, gaps as well."""
    return hamming(a, b)


def base_letter(x: Column | str) -> Column:
    """The upper-case letter of a nucleotide, N for any other."""
    return F.when(F.upper(_col(x)).isin(*BASES), F.upper(_col(x))).otherwise("N")


def kmer_array(seq: Column | str, k: int) -> Column:
    """All k-letter windows of a sequence in order."""
    s = _col(seq)
    places = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(s, i, F.lit(k)))


def same_strand(a: Column | str, b: Column | str, k: int) -> Column:
    """Whether two sequences share more k-mers as they stand than with one turned; a tie says turned."""
    own = F.array_distinct(kmer_array(a, k))
    return F.size(F.array_intersect(own, kmer_array(b, k))) > F.size(F.array_intersect(own, kmer_array(reverse_complement(b), k)))


def clean_name(name: Column | str, find: str, replace: str = "") -> Column:
    """A sequence's name with all that a pattern finds replaced."""
    return F.regexp_replace(_col(name), find, replace)


def pack_words(kmer: Column | str, k: int, word: int = 31) -> Column:
    """2 bits a base in words of at most 31 letters, in order: for k-mers of any length."""
    s = _col(kmer)
    return F.array(*[pack(F.substr(s, F.lit(i + 1), F.lit(min(word, k - i)))) for i in range(0, k, word)])


def unpack_words(words: Column, k: int, word: int = 31) -> Column:
    return F.concat(*[unpack(F.element_at(words, n + 1), min(word, k - i)) for n, i in enumerate(range(0, k, word))])


def cigar_of(query: Column | str, target: Column | str) -> Column:
    """The CIGAR text of two aligned texts with gaps as dashes."""
    q, t = _col(query), _col(target)
    kinds = F.transform(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda i: F.when(F.substr(q, i, F.lit(1)) == "-", "D").when(F.substr(t, i, F.lit(1)) == "-", "I").otherwise("M"))
    runs = F.regexp_extract_all(F.array_join(kinds, ""), F.lit("(M+|I+|D+)"), 1)
    return F.when(F.length(q) == 0, "").otherwise(F.array_join(F.transform(runs, lambda x: F.concat(F.length(x).cast("string"), F.left(x, F.lit(1)))), ""))
