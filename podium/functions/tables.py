"""Table functions for SQL: of one row many (`frame_times`, in a lateral join), and of a table's parts segments (`voice_segments`).

    SELECT v.id, f.* FROM videos v, LATERAL frame_times(v.seconds, prefix => 'img_') f
    SELECT * FROM voice_segments(TABLE(frames), key => 'recording', order => 'frame_idx', voiced => 'is_speech')

What columns they give follows from their arguments (`analyze`). `register(spark)` makes them known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from podium.operators.speech import VoiceState


def _constant(name: str, argument: AnalyzeArgument | None, default=None):
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


@udtf
class FrameTimes:
    """Seconds of a video to its frames: frame_number (the second it stands for) and ts, one each `every` seconds; without `every`
    as `scalars.frame_interval` has it. With `prefix` a column name too: prefix, frame number, .jpg. No length or none above 0 gives no frames."""

    @staticmethod
    def analyze(seconds: AnalyzeArgument, every: AnalyzeArgument | None = None, prefix: AnalyzeArgument | None = None) -> AnalyzeResult:
        _constant("every", every)
        schema = StructType().add("frame_number", IntegerType()).add("ts", DoubleType())
        return AnalyzeResult(schema.add("name", StringType()) if _constant("prefix", prefix) is not None else schema)

    def eval(self, seconds, every=None, prefix=None) -> Iterator[tuple]:
        if seconds is None or not seconds > 0:
            return
        seconds = float(seconds)
        wanted = 100 if seconds < 1200 else 300 if seconds > 4800 else 200
        step = float(every) if every is not None else max(1, math.floor(seconds / wanted + 0.5))
        for i in range(math.ceil(seconds / step)):
            number = math.floor(i * step)
            yield (number, float(i * step), f"{prefix}{number}.jpg") if prefix is not None else (number, float(i * step))


@udtf
class VoiceSegments:
    """Frames of recordings to segments: the key, segment (from 1), first, last, n_frames. Frames are brought together by key and sorted by Spark and pass through
    one by one, so a recording of any length needs a ring of memory."""

    def __init__(self):
        self.state, self.key, self.segment, self.open = None, None, 0, None

    @staticmethod
    def analyze(frames: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, voiced: AnalyzeArgument, ring: AnalyzeArgument | None = None, ratio: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not frames.isTable:
            raise ValueError("the frames must be a TABLE")
        names = [_constant(name, x) for name, x in (("key", key), ("order", order), ("voiced", voiced))]
        missing = set(names) - set(frames.dataType.names)
        if missing:
            raise ValueError(f"no column {', '.join(map(str, sorted(missing)))}")
        _constant("ring", ring), _constant("ratio", ratio)
        schema = StructType().add(frames.dataType[names[0]])
        for column in ("segment", "first", "last", "n_frames"):
            schema = schema.add(column, LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def eval(self, frames: Row, key: str, order: str, voiced: str, ring: int = 10, ratio: float = 0.9) -> Iterator[tuple]:
        if self.state is None:
            self.state, self.key = VoiceState(int(ring), float(ratio)), frames[key]
        got, ended = self.state.feed(frames[order], bool(frames[voiced]))
        if got:
            first, n = (self.open[0], self.open[2]) if self.open else (got[0], 0)
            self.open = (first, got[-1], n + len(got))
        if ended:
            yield self._given()

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self._given()

    def _given(self) -> tuple:
        self.segment += 1
        out, self.open = (self.key, self.segment, *self.open), None
        return out


def register(spark: SparkSession) -> None:
    spark.udtf.register("frame_times", FrameTimes)
    spark.udtf.register("voice_segments", VoiceSegments)
