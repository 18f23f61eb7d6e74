"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STR, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

MANIFEST = _struct(ID=STR, duration=DOUBLE, wav=STR, tun_transcription=STR, tun_slu_annotation=STR, intent=STR)
SLOTS = T.ArrayType(_struct(label=STR, value=STR))
ITEM = _struct(id=STR, text=STR, annotated=STR, intent=STR, slots=SLOTS, meta=_struct(mode=STR, batch=STR, model=STR))
VERDICT = _struct(item_id=STR, annotator=STR, annotator_pos=INT, derja=STR, natural=STR, intent_match=STR, slots_ok=STR, fixed_annotated=STR)
META = _struct(id=STR, subtask=STR, family=STR, split=STR, intent=STR, ref=STR)
RESULT = _struct(response=STR, meta=META)
SCORE = _struct(id=STR, wav=STR, gold=STR, hyp=STR, wer=DOUBLE)
CHAT = _struct(messages=T.ArrayType(_struct(role=STR, content=STR)), audios=T.ArrayType(STR), meta=META)
LOG = _struct(log_history=T.ArrayType(_struct(step=LONG, eval_loss=DOUBLE)))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the schema's columns in its order; absent ones are null, others go; values that don't fit are null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
