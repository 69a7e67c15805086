"""Rows that the operators are tried on."""
SF = "/root/testdata/sf0.001"

#: Documents with nulls, empty and odd texts, ties, and repeats of each other.
LINE = "The same long line that stands in several documents"
PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "a"), (6, "  two   spaces  "),
    (7, f"{LINE}\nown\n {LINE.upper()}\t"), (8, f"{LINE}\n{LINE}"), (9, f"x\n{LINE.lower()}"),
    (10, PASSAGE), (11, PASSAGE), (12, f"before {PASSAGE} after"),
    (13, PASSAGE.replace("word30", "other")), (14, "again " * 300), (15, "again " * 120),
    (16, "é ü ñ ▁ marker ▁▁ x▁y   　 🙂".encode("utf-16", "surrogatepass").decode("utf-16")),
    (17, "\t tab\x0bvertical\x0cfeed\rreturn"), (18, PASSAGE + "\n" + PASSAGE),
    (19, "ä" * 450), (20, "ab" * 700), (21, "nul \x00 byte <s> </s> <0x0A>"),
    (22, " ".join(f"Word{i}" for i in range(60))), (-3, "x " + PASSAGE[:330]),
]
