"""Names of numeric platform constants in statements, and tokens that stand for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Platform constants by enum.
ENUMS = {
    "AudioSource": {"0": "DEFAULT", "1": "MIC", "4": "CAMCORDER", "5": "VOICE_RECOGNITION", "6": "VOICE_COMMUNICATION", "7": "REMOTE_SUBMIX", "9": "UNPROCESSED"},
    "OutputFormat": {"0": "DEFAULT", "1": "THREE_GPP", "2": "MPEG_4", "3": "AMR_NB", "4": "AMR_WB", "6": "WEBM"},
    "AudioEncoder": {"0": "DEFAULT", "1": "AMR_NB", "2": "AMR_WB", "3": "AAC", "4": "HE_AAC", "5": "AAC_ELD", "6": "VORBIS", "7": "OPUS"},
    "VideoSource": {"0": "DEFAULT", "1": "CAMERA", "2": "SURFACE"},
    "WindowType": {"1": "TYPE_BASE_APPLICATION", "2": "TYPE_APPLICATION", "3": "TYPE_APPLICATION_STARTING", "1000": "TYPE_STATUS_BAR", "2002": "TYPE_SYSTEM_ALERT", "2003": "TYPE_TOAST", "2010": "TYPE_SYSTEM_OVERLAY", "2038": "TYPE_APPLICATION_OVERLAY"},
    "ForegroundServiceType": {"0": "FOREGROUND_SERVICE_TYPE_MANIFEST", "1": "FOREGROUND_SERVICE_TYPE_DATA_SYNC", "2": "FOREGROUND_SERVICE_TYPE_MEDIA_PLAYBACK", "4": "FOREGROUND_SERVICE_TYPE_PHONE_CALL", "8": "FOREGROUND_SERVICE_TYPE_LOCATION", "16": "FOREGROUND_SERVICE_TYPE_CONNECTED_DEVICE", "64": "FOREGROUND_SERVICE_TYPE_CAMERA", "128": "FOREGROUND_SERVICE_TYPE_MICROPHONE", "256": "FOREGROUND_SERVICE_TYPE_HEALTH", "512": "FOREGROUND_SERVICE_TYPE_REMOTE_MESSAGING", "1024": "FOREGROUND_SERVICE_TYPE_SYSTEM_EXEMPTED", "1073741824": "FOREGROUND_SERVICE_TYPE_SHORT_SERVICE"},
    "IntentFlags": {"268435456": "FLAG_ACTIVITY_NEW_TASK", "67108864": "FLAG_ACTIVITY_CLEAR_TASK", "536870912": "FLAG_ACTIVITY_SINGLE_TOP", "33554432": "FLAG_ACTIVITY_CLEAR_TOP", "524288": "FLAG_ACTIVITY_NEW_DOCUMENT", "32": "FLAG_GRANT_READ_URI_PERMISSION", "64": "FLAG_GRANT_WRITE_URI_PERMISSION"},
}
#: Method (lower case), enum of its argument, place of the argument.
METHODS = {
    "setaudiosource": ("AudioSource", 0), "setoutputformat": ("OutputFormat", 0), "setaudioencoder": ("AudioEncoder", 0), "setvideosource": ("VideoSource", 0),
    "settype": ("WindowType", 0), "startforeground": ("ForegroundServiceType", 1), "setflags": ("IntentFlags", 0), "addflags": ("IntentFlags", 0), "layoutparams": ("WindowType", 0),
}
#: The same for a method of one class.
QUALIFIED = {
    "android.media.MediaRecorder.setAudioSource": ("AudioSource", 0), "android.media.MediaRecorder.setOutputFormat": ("OutputFormat", 0), "android.media.MediaRecorder.setAudioEncoder": ("AudioEncoder", 0),
    "android.media.MediaRecorder.setVideoSource": ("VideoSource", 0), "android.view.WindowManager.LayoutParams.<init>": ("WindowType", 2), "android.app.Service.startForeground": ("ForegroundServiceType", 1),
}
#: Other names of constants in claims. Of repeated keys the last counts.
CONSTANT_ALIASES = dict((
    ("0", ["default", "audiosource"]), ("1", ["mic", "microphone", "audiosource.mic"]), ("4", ["camcorder"]), ("5", ["voice_recognition"]), ("6", ["voice_communication"]), ("7", ["remote_submix"]),
    ("2", ["mpeg_4", "mpeg4"]), ("3", ["amr_nb", "amrnb"]), ("2", ["type_phone", "type_application"]), ("2002", ["type_system_alert"]), ("2003", ["type_toast"]), ("2010", ["type_system_overlay"]),
    ("2038", ["type_application_overlay", "application_overlay"]), ("8", ["flag_not_focusable", "not_focusable"]), ("16777216", ["flag_hardware_accelerated"]), ("268435456", ["flag_activity_new_task", "new_task"]),
    ("67108864", ["flag_activity_clear_task", "clear_task"]), ("_id", ["id", "column_id"]), ("-3", ["translucent", "pixelformat.translucent"]), ("17", ["center", "gravity.center"]), ("0", ["get_activities", "get_services", "get_receivers"]),
))
#: Other names of methods in claims.
METHOD_ALIASES = {
    "getdeviceid": ["imei", "device_id", "deviceid"], "getsubscriberid": ["imsi", "subscriber_id", "subscriberid"], "getimei": ["imei", "device_id"], "getline1number": ["phone_number", "line1", "phonenumber"],
    "setaudiosource": ["audiosource", "mic", "microphone", "audio_source"], "setoutputformat": ["outputformat", "output_format", "mpeg"], "setaudioencoder": ["audioencoder", "audio_encoder", "amr"], "setoutputfile": ["outputfile", "output_file", "filepath"],
    "getmediaprojection": ["mediaprojection", "media_projection", "screen_capture"], "addview": ["overlay", "window", "view"], "getinputstream": ["inputstream", "input_stream", "socket_input"], "getoutputstream": ["outputstream", "output_stream", "socket_output"],
}
INVOKE = r"(invoke\w*)\s*(\$?\w+)\.<([^:]+):\s*([^>]+)>\s*\(([^)]*)\)"


def enum_table(spark: SparkSession) -> DataFrame:
    rows = [(name, enum, place, constant, meaning) for name, (enum, place) in METHODS.items() for constant, meaning in ENUMS[enum].items()]
    return spark.createDataFrame(rows, "method string, enum string, place int, constant string, meaning string")


def annotate(units: DataFrame) -> DataFrame:
    """units (with stmt) plus annotated, and annotation: struct<method,class,constant,semantic,enum_type>, null where the call
    has no known constant. The constant's meaning is put behind its argument."""
    part = lambda g: F.regexp_extract("stmt", INVOKE, g)
    rows = units.withColumn("_class", part(3)).withColumn("_method", F.regexp_extract(part(4), r"(\w+)\s*\([^)]*\)", 1)).withColumn("_args", part(5))
    info = F.lit(None).cast("struct<enum:string,place:int>")
    for table, key in ((METHODS, F.lower("_method")), (QUALIFIED, F.concat_ws(".", "_class", "_method"))):
        for name, (enum, place) in table.items():
            info = F.when(key == name, F.struct(F.lit(enum).alias("enum"), F.lit(place).alias("place"))).otherwise(info)
    rows = rows.withColumn("_info", info).withColumn("_list", F.transform(F.split("_args", ","), lambda a: F.trim(a)))
    place = F.least(F.col("_info.place"), F.size("_list") - 1)
    rows = rows.withColumn("_place", place).withColumn("_constant", F.regexp_extract(F.get("_list", place), r"\b(\d+)\b", 1))
    meaning = F.lit(None).cast("string")
    for enum, values in ENUMS.items():
        for constant, name in values.items():
            meaning = F.when((F.col("_info.enum") == enum) & (F.col("_constant") == constant), name).otherwise(meaning)
    rows = rows.withColumn("_meaning", meaning)
    told = F.transform("_list", lambda a, i: F.when(i == F.col("_place"), F.concat(a, F.lit(" /* "), F.col("_meaning"), F.lit(" */"))).otherwise(a))
    text = F.replace(F.col("stmt"), F.concat(F.lit("("), F.col("_args"), F.lit(")")), F.concat(F.lit("("), F.array_join(told, ", "), F.lit(")")))
    known = F.col("_meaning").isNotNull()
    out = rows.withColumn("annotated", F.when(known, text).otherwise(F.col("stmt"))).withColumn("annotation", F.when(known, F.struct(F.col("_method").alias("method"), F.col("_class").alias("class"), F.col("_constant").alias("constant"), F.col("_meaning").alias("semantic"), F.col("_info.enum").alias("enum_type"))))
    return out.drop("_class", "_method", "_args", "_info", "_list", "_place", "_constant", "_meaning")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numeric_constants(text: Column) -> Column:
    """Distinct numbers in parentheses and assignments, negative ones with their sign."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.concat(every(r"\((\d+)\)"), every(r"=\s*(\d+)\s*[;,\)]"), F.transform(every(r"\(-(\d+)\)"), lambda x: F.concat(F.lit("-"), x))))


def semantic_tokens(text: Column) -> Column:
    """Names that stand for the constants and methods of a text, sorted."""
    return let(F.struct(numeric_constants(text).alias("found"), F.lower(text).alias("text")), _names_of)


def _names_of(x: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.when(F.array_contains(x["found"], k), F.array(*map(F.lit, names))).otherwise(none) for k, names in CONSTANT_ALIASES.items()]
    parts += [F.when(F.contains(x["text"], F.lit(k)), F.array(*map(F.lit, names))).otherwise(none) for k, names in METHOD_ALIASES.items()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))
