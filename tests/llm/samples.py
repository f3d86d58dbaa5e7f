"""Traffic events with awkward descriptions, and plain Python twins of the word rules."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STREETS = "penn forbes fifth butler liberty grant smallman carson baum negley murray shady beechwood".split()
FILL = "the road is closed between and due to snow on of near ramp lane crews plow salt ice from at for with".split()

#: Names that operators use inside; all must pass through or be replaced as documented.
CLASHING = ["row", "text", "tokens", "grams", "order", "starts", "n_words", "digest", "node", "bands", "block", "of", "id",
            "label", "rank", "bucket", "length", "epoch.part", "hash", "__page2"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sentence(random_, words):
    return " ".join(random_.choice(FILL if random_.random() < 0.6 else STREETS) + (
        str(random_.randint(1, 99)) if random_.random() < 0.1 else "") for _ in range(words))


def descriptions(n=40, seed=3):
    """(event_id, description): random ones, near copies, copies, awkward ones."""
    r = random.Random(seed)
    rows = [(i, sentence(r, r.randint(30, 160)).capitalize() + ".") for i in range(n)]
    rows += [(100 + i, rows[i][1] + " Expect delays.") for i in range(8)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "ice"), (304, "Ice"), (305, "ice ice"), (306, "a b c"),
             (307, "Été  neige\x0bverglas \r\n été"), (308, "salt " * 400), (309, "# " * 60 + "| $ %"),
             (310, "same line here\n" * 30), (None, "no id at all here"), (311, "x" * 5000),
             (312, sentence(r, 20000)), (313, "a  b   c\n d " * 30), (314, "x <|endoftext|> y"), (303, "ice")]
    return rows


def events(spark, rows=None, clash=True):
    """The rows as traffic events with a source, and with columns whose names clash with working columns."""
    rows = descriptions() if rows is None else rows
    names = CLASHING if clash else []
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("description", T.StringType()),
                           T.StructField("data_source", T.StringType()), *[T.StructField(c, T.StringType()) for c in names]])
    sources = ["511pa"] * 6 + ["press", "press", "domi", None]
    return spark.createDataFrame([(i, t, sources[k % 10], *[None] * len(names)) for k, (i, t) in enumerate(rows)], schema)
