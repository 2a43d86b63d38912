"""Tag names and the directories they belong to."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from tagloom.functions.directories import IFDS

# Fixed values of the Exif standard: tag number -> (name, type code).
IFD0 = {
    0x0100: ("ImageWidth", 4),
    0x0101: ("ImageLength", 4),
    0x0102: ("BitsPerSample", 3),
    0x0103: ("Compression", 3),
    0x0106: ("PhotometricInterpretation", 3),
    0x010E: ("ImageDescription", 2),
    0x010F: ("Make", 2),
    0x0110: ("Model", 2),
    0x0111: ("StripOffsets", 4),
    0x0112: ("Orientation", 3),
    0x0115: ("SamplesPerPixel", 3),
    0x0116: ("RowsPerStrip", 4),
    0x0117: ("StripByteCounts", 4),
    0x011A: ("XResolution", 5),
    0x011B: ("YResolution", 5),
    0x011C: ("PlanarConfiguration", 3),
    0x0128: ("ResolutionUnit", 3),
    0x012D: ("TransferFunction", 3),
    0x0131: ("Software", 2),
    0x0132: ("DateTime", 2),
    0x013B: ("Artist", 2),
    0x013E: ("WhitePoint", 5),
    0x013F: ("PrimaryChromaticities", 5),
    0x0201: ("JPEGInterchangeFormat", 4),
    0x0202: ("JPEGInterchangeFormatLength", 4),
    0x0211: ("YCbCrCoefficients", 5),
    0x0212: ("YCbCrSubSampling", 3),
    0x0213: ("YCbCrPositioning", 3),
    0x0214: ("ReferenceBlackWhite", 5),
    0x8298: ("Copyright", 2),
    0x8769: ("ExifIFDPointer", 4),
    0x8825: ("GPSInfoIFDPointer", 4),
}
EXIF = {
    0x829A: ("ExposureTime", 5),
    0x829D: ("FNumber", 5),
    0x8822: ("ExposureProgram", 3),
    0x8824: ("SpectralSensitivity", 2),
    0x8827: ("PhotographicSensitivity", 3),
    0x8828: ("OECF", 7),
    0x8830: ("SensitivityType", 3),
    0x8831: ("StandardOutputSensitivity", 4),
    0x8832: ("RecommendedExposureIndex", 4),
    0x8833: ("ISOSpeed", 4),
    0x8834: ("ISOSpeedLatitudeyyy", 4),
    0x8835: ("ISOSpeedLatitudezzz", 4),
    0x9000: ("ExifVersion", 7),
    0x9003: ("DateTimeOriginal", 2),
    0x9004: ("DateTimeDigitized", 2),
    0x9010: ("OffsetTime", 2),
    0x9011: ("OffsetTimeOriginal", 2),
    0x9012: ("OffsetTimeDigitized", 2),
    0x9101: ("ComponentsConfiguration", 7),
    0x9102: ("CompressedBitsPerPixel", 5),
    0x9201: ("ShutterSpeedValue", 10),
    0x9202: ("ApertureValue", 5),
    0x9203: ("BrightnessValue", 10),
    0x9204: ("ExposureBiasValue", 10),
    0x9205: ("MaxApertureValue", 5),
    0x9206: ("SubjectDistance", 5),
    0x9207: ("MeteringMode", 3),
    0x9208: ("LightSource", 3),
    0x9209: ("Flash", 3),
    0x920A: ("FocalLength", 5),
    0x9214: ("SubjectArea", 3),
    0x927C: ("MakerNote", 7),
    0x9286: ("UserComment", 7),
    0x9290: ("SubSecTime", 2),
    0x9291: ("SubSecTimeOriginal", 2),
    0x9292: ("SubSecTimeDigitized", 2),
    0x9400: ("Temperature", 10),
    0x9401: ("Humidity", 5),
    0x9402: ("Pressure", 5),
    0x9403: ("WaterDepth", 10),
    0x9404: ("Acceleration", 5),
    0x9405: ("CameraElevationAngle", 10),
    0xA000: ("FlashpixVersion", 7),
    0xA001: ("ColorSpace", 3),
    0xA002: ("PixelXDimension", 4),
    0xA003: ("PixelYDimension", 4),
    0xA004: ("RelatedSoundFile", 2),
    0xA005: ("InteroperabilityIFDPointer", 4),
    0xA20B: ("FlashEnergy", 5),
    0xA20C: ("SpatialFrequencyResponse", 7),
    0xA20E: ("FocalPlaneXResolution", 5),
    0xA20F: ("FocalPlaneYResolution", 5),
    0xA210: ("FocalPlaneResolutionUnit", 3),
    0xA214: ("SubjectLocation", 3),
    0xA215: ("ExposureIndex", 5),
    0xA217: ("SensingMethod", 3),
    0xA300: ("FileSource", 7),
    0xA301: ("SceneType", 7),
    0xA302: ("CFAPattern", 7),
    0xA401: ("CustomRendered", 3),
    0xA402: ("ExposureMode", 3),
    0xA403: ("WhiteBalance", 3),
    0xA404: ("DigitalZoomRatio", 5),
    0xA405: ("FocalLengthIn35mmFilm", 3),
    0xA406: ("SceneCaptureType", 3),
    0xA407: ("GainControl", 3),
    0xA408: ("Contrast", 3),
    0xA409: ("Saturation", 3),
    0xA40A: ("Sharpness", 3),
    0xA40B: ("DeviceSettingDescription", 7),
    0xA40C: ("SubjectDistanceRange", 3),
    0xA420: ("ImageUniqueID", 2),
    0xA430: ("CameraOwnerName", 2),
    0xA431: ("BodySerialNumber", 2),
    0xA432: ("LensSpecification", 5),
    0xA433: ("LensMake", 2),
    0xA434: ("LensModel", 2),
    0xA435: ("LensSerialNumber", 2),
    0xA500: ("Gamma", 5),
}
GPS = {
    0x0000: ("GPSVersionID", 1),
    0x0001: ("GPSLatitudeRef", 2),
    0x0002: ("GPSLatitude", 5),
    0x0003: ("GPSLongitudeRef", 2),
    0x0004: ("GPSLongitude", 5),
    0x0005: ("GPSAltitudeRef", 1),
    0x0006: ("GPSAltitude", 5),
    0x0007: ("GPSTimeStamp", 5),
    0x0008: ("GPSSatellites", 2),
    0x0009: ("GPSStatus", 2),
    0x000A: ("GPSMeasureMode", 2),
    0x000B: ("GPSDOP", 5),
    0x000C: ("GPSSpeedRef", 2),
    0x000D: ("GPSSpeed", 5),
    0x000E: ("GPSTrackRef", 2),
    0x000F: ("GPSTrack", 5),
    0x0010: ("GPSImgDirectionRef", 2),
    0x0011: ("GPSImgDirection", 5),
    0x0012: ("GPSMapDatum", 2),
    0x0013: ("GPSDestLatitudeRef", 2),
    0x0014: ("GPSDestLatitude", 5),
    0x0015: ("GPSDestLongitudeRef", 2),
    0x0016: ("GPSDestLongitude", 5),
    0x0017: ("GPSDestBearingRef", 2),
    0x0018: ("GPSDestBearing", 5),
    0x0019: ("GPSDestDistanceRef", 2),
    0x001A: ("GPSDestDistance", 5),
    0x001B: ("GPSProcessingMethod", 7),
    0x001C: ("GPSAreaInformation", 7),
    0x001D: ("GPSDateStamp", 2),
    0x001E: ("GPSDifferential", 3),
    0x001F: ("GPSHPositioningError", 5),
}
HOMES = [("ifd0", IFD0), ("exif", EXIF), ("gps", GPS)]

_BY_NAME = {name: (ifd, tag) for ifd, tags in HOMES for tag, (name, _) in tags.items()}


def resolve(names: Sequence[str | tuple[str, int]]) -> list[tuple[str, str, int]]:
    """Column name, directory and tag number of each requested tag.

    A tag is asked for by its name in the standard, or as (directory, number),
    which gives a column such as ``ifd1_259``.
    """
    if not names:
        raise ValueError("no tags asked for")
    found = []
    for name in names:
        if isinstance(name, str) and name in _BY_NAME:
            found.append((name, *_BY_NAME[name]))
        elif not isinstance(name, str) and name[0] in IFDS:
            ifd, tag = name[0], int(name[1])
            found.append((f"{ifd}_{tag}", ifd, tag))
        else:
            raise ValueError(f"unknown tag: {name}")
    return found


def home_directory(tag: str) -> str:
    """SQL: the directory the standard puts a tag number in; else the main one."""
    return f"""CASE WHEN {tag} IN ({_listed(EXIF)}) THEN 'exif'
        WHEN {tag} IN ({_listed(GPS)}) THEN 'gps' ELSE 'ifd0' END"""


def standard_type(ifd: str, tag: str) -> str:
    """SQL: the type code the standard gives a tag; text for any other tag."""
    cases = []
    for name, tags in HOMES:
        for code in sorted({code for _, code in tags.values()}):
            numbers = _listed(t for t, (_, c) in tags.items() if c == code)
            cases.append(f"WHEN {ifd} = '{name}' AND {tag} IN ({numbers}) THEN {code}")
    return f"CASE {' '.join(cases)} ELSE 2 END"


def _listed(numbers: Iterable[int]) -> str:
    return ", ".join(str(n) for n in numbers)
