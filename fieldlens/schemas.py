"""Explicit schemas, parameter sets with their defaults and checks, and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# ---- fixed values: they must equal the published ones for right results ----
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")
CALIBRATION_EXTENSIONS = ("jpg", "jpeg", "png", "bmp")
CLASS_NAMES = ("bird", "head", "eye", "beak")
SHIFTED_MODEL_SIZE = 384  # at this model size class 0 is background and the names move up by one
PART_GROUPS = {"head": (2, 5, 6, 7, 10, 11, 15), "eye": (7, 11), "beak": (2,), "crown": (5,), "tail": (14,)}
KEYPOINT_NAMES = (
    "Head_Mid_Top", "Eye_Left", "Eye_Right", "Mouth_Front_Top", "Mouth_Back_Left", "Mouth_Back_Right",
    "Mouth_Front_Bottom", "Shoulder_Left", "Shoulder_Right", "Elbow_Left", "Elbow_Right", "Wrist_Left",
    "Wrist_Right", "Torso_Mid_Back", "Hip_Left", "Hip_Right", "Knee_Left", "Knee_Right", "Ankle_Left",
    "Ankle_Right", "Tail_Top_Back", "Tail_Mid_Back", "Tail_End_Back",
)
ARTIFACT_TYPES = (
    ("fp16", "FP16"), ("dynamic-int8", "Dynamic INT8"), ("static-int8", "Static INT8"),
    ("dynamic", "Dynamic"), ("static", "Static"), ("int8", "INT8"),
)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
MOS_MEAN, MOS_STD_LEFT, MOS_STD_RIGHT = 72.59696108881171, 7.798274017370107, 4.118047289170692
MOS_CATEGORIES = ("Bad", "Poor", "Fair", "Good", "Excellent")
SMALL_SCALE_BIAS = 1.25  # the half-size scale uses threshold * ratio * bias
MASK_FORMAT = "rle-binary-v1 | gzip | base64"
IOU_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREA_RANGES = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
MAX_DETECTIONS = (1, 10, 100)
RECALL_POINTS = 101


@dataclass(frozen=True)
class QualityParams:
    beta: float = 1.2
    tau: float = 0.02
    p_floor: float = 0.0
    alpha: float = 0.7
    min_weight: float = 0.2
    size_ref: float = 96.0
    coverage_ref: float = 4.0
    core_ratio: float = 0.60

    # documented ranges of the tunable fields
    RANGES = {"beta": (0.5, 2.0), "tau": (0.001, 0.1), "p_floor": (0.0, 0.1), "alpha": (0.0, 1.0), "min_weight": (0.0, 0.5)}

    def violations(self) -> list[str]:
        return [f"{k}={getattr(self, k)} outside [{lo}, {hi}]" for k, (lo, hi) in self.RANGES.items()
                if not lo <= getattr(self, k) <= hi]

    def as_column(self) -> Column:
        return F.struct(*[F.lit(float(getattr(self, f.name))).alias(f.name) for f in fields(self)])


@dataclass(frozen=True)
class TriageParams:
    ratio_bad: float = 1.19
    cells_bad: float = 6.15
    delta_bad_ratio: float = 0.4
    delta_bad_cells: float = 1.5
    delta_good_ratio: float = 0.0
    delta_good_cells: float = 0.0


DETECTION = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("det_id", T.IntegerType()),
    T.StructField("class_id", T.IntegerType()), T.StructField("class_name", T.StringType()),
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()), T.StructField("y2", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("angle", T.DoubleType()),
])

CATALOG = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("modificationTime", T.TimestampType()),
])

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])

MASK_ENTRY = T.StructType([
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("format", T.StringType()), T.StructField("start_value", T.IntegerType()),
    T.StructField("order", T.StringType()), T.StructField("data", T.StringType()),
])

COCO_IMAGE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
])
COCO_ANNOTATION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()),
    T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("area", T.DoubleType()), T.StructField("iscrowd", T.IntegerType()),
    T.StructField("orient", T.DoubleType()),
])
COCO_CATEGORY = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("supercategory", T.StringType()),
])
COCO_DOCUMENT = T.StructType([
    T.StructField("images", T.ArrayType(COCO_IMAGE)), T.StructField("annotations", T.ArrayType(COCO_ANNOTATION)),
    T.StructField("categories", T.ArrayType(COCO_CATEGORY)),
])

CLASS_METRIC = T.StructType([
    T.StructField("class", T.StringType()), T.StructField("map@50:95", T.DoubleType()),
    T.StructField("map@50", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
])
RESULT_SECTION = T.StructType([T.StructField("class_map", T.ArrayType(CLASS_METRIC))])
METRIC_LOG = T.StructType([
    T.StructField("epoch", T.IntegerType()), T.StructField("test_results_json", RESULT_SECTION),
    T.StructField("ema_test_results_json", RESULT_SECTION),
])

_SUMMARY = T.StructType([T.StructField(k, T.DoubleType()) for k in ("mean", "median", "min", "max", "stdev")])
BENCHMARK_ENTRY = T.StructType([
    T.StructField("runs", T.IntegerType()), T.StructField("load_time", _SUMMARY),
    T.StructField("inference_time", _SUMMARY), T.StructField("total_time", _SUMMARY),
])

MOS_LABELS = T.StructType(
    [T.StructField("name_image", T.StringType())]
    + [T.StructField(f"mos_{r}", T.DoubleType()) for r in ("image", "patch_1", "patch_2", "patch_3")]
    + [T.StructField(f"{side}_{r}", T.DoubleType()) for r in ("image", "patch_1", "patch_2", "patch_3")
       for side in ("left", "top", "right", "bottom")]
    + [T.StructField("is_valid", T.BooleanType())]
)
