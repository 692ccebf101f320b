"""Small tables with the awkward rows every operator must bear."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, fp string, n string, comp string"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7))) for _ in range(n))


def doc_rows(seed=7, plain=40):
    """(doc_id, text): prose, copies, near copies, ties, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(plain)]
    base = prose(rng, 60).split()
    for i in range(100, 125):  # near copies, each with a few words changed
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    for i in range(200, 215):  # short sets around the least sizes
        words = "a b c d e f g h i j k l m".split()[: rng.randint(4, 13)]
        rows.append((i, " ".join(words)))
    passage = prose(rng, 30)
    rows += [(i, prose(rng, 5) + "\n" + passage + "\n" + prose(rng, 6)) for i in range(300, 310)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "One"), (405, prose(rng, 20000)), (None, prose(rng, 12)), (None, None)]
    rows += [rows[3], rows[41], (41, rows[41][1].upper()), (406, "ünï cödé word ０  x"), (407, rows[5][1])]
    return rows


def doc_frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s%d" % ((i or 0) % 3), len(t) if t is not None else None, "k", "f", "n", "c") for i, t in rows], DOC_SCHEMA).repartition(3)
