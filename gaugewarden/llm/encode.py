"""Token ids of documents by the tokenizers library, cut into pieces."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import library_encoder, text_blocks


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, piece_tokens: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, piece, start, length, ids): each text's ids and ``end_id``, cut every ``piece_tokens`` ids.

    ``ids`` are little-endian unsigned 32-bit integers. Special strings inside
    texts are what the library makes of them; none are added. A null text is
    empty and gives the end id alone. Repeated rows give repeated pieces; other columns are not read.
    """
    end = np.uint32(end_id).tobytes()
    size = 4 * piece_tokens

    @F.pandas_udf("array<binary>")
    def pieces(texts: pd.Series) -> pd.Series:
        encode = library_encoder(tokenizer).encode
        whole = [ids + end for block in text_blocks(texts) for ids in encode(block)]
        return pd.Series([[w[i:i + size] for i in range(0, len(w), size)] for w in whole])

    return docs.select(F.col(key).alias(key), F.posexplode(pieces(F.coalesce(F.col(text), F.lit("")))).alias("piece", "ids")).select(
        key, "piece", (F.col("piece").cast("long") * piece_tokens).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("length"), "ids")
