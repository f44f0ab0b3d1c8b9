"""Small documents with everything that may go wrong in them, and plain Python versions of what is asked."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, size int, target double, fp string, p string, "
          "tok string, h long, part int, seg int, label string, _id string, rng string, cell int, e int, token_ids string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORDS.findall(text or "")


def vocabulary(rng, letters, n=60):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def texts(seed=1):
    rng = random.Random(seed)
    tongues = {"aa": vocabulary(rng, "abcdef"), "bb": vocabulary(rng, "klmnop"), "cc": vocabulary(rng, "éèàuvw")}
    rows = []
    for k in range(60):
        lang = rng.choice(sorted(tongues))
        rows.append((lang, " ".join(rng.choice(tongues[lang]) for _ in range(rng.randint(5, 150)))))
    return rows, tongues, rng


def documents(seed=1):
    """(doc_id, text, lang, source) rows."""
    rows, tongues, rng = texts(seed)
    out = [(3 * k, t, lang, f"s{k % 4}" if k % 9 else None) for k, (lang, t) in enumerate(rows)]
    passage = " ".join(rng.choice(tongues["aa"]) for _ in range(60))
    out += [(200 + k, out[k][1], out[k][2], "s0") for k in range(8)]  # exact copies
    out += [(220 + k, out[20 + k][1] + " extra", None, "s1") for k in range(8)]  # near copies
    out += [(240 + k, f"{out[30 + k][1]} {passage}\t{out[40 + k][1]}", "aa", "s2") for k in range(6)]  # a shared passage
    out.append((300, " ".join(rng.choice(tongues["bb"]) for _ in range(40_000)), "bb", "s3"))  # very long
    out += [(301, None, "aa", "s0"), (302, "", "bb", "s0"), (303, " \t\n\r ", None, None), (304, "12 34 !!", "aa", "s1"), (None, "abc def", "aa", "s1"),
            (None, None, None, None), (305, "One Two", "cc", "s2"), (306, "word", None, "s2"), (307, "a a a a a a " * 30, "aa", "s3"), (307, "a a a a a a " * 30, "aa", "s3"),
            (-5, "x" * 5000, "bb", "s0"), (308, "Ünï çödé 𝒳𝒴 ▁mark▁ x", "cc", "s1")]
    return out


def frame(spark, rows):
    wide = [(i, t, lang, s, None if t is None else len(t), "row", 1, 2.0, "fp", "p", "tok", 5, 1, 2, "label", "id", "rng", 3, 4, "ids") for i, t, lang, s in rows]
    return spark.createDataFrame(wide, SCHEMA)
