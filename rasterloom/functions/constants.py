"""Fixed values of the format: tags, field types, codes."""

# field types: code -> (name, bytes, struct letter)
FIELD_TYPES = {
    1: ("BYTE", 1, "B"), 2: ("ASCII", 1, "s"), 3: ("SHORT", 2, "H"), 4: ("LONG", 4, "I"), 5: ("RATIONAL", 8, "I"), 6: ("SBYTE", 1, "b"),
    7: ("UNDEFINED", 1, "B"), 8: ("SSHORT", 2, "h"), 9: ("SLONG", 4, "i"), 10: ("SRATIONAL", 8, "i"), 11: ("FLOAT", 4, "f"), 12: ("DOUBLE", 8, "d"),
    13: ("IFD", 4, "I"), 16: ("LONG8", 8, "Q"), 17: ("SLONG8", 8, "q"), 18: ("IFD8", 8, "Q"),
}
UNSIGNED = (1, 3, 4, 13, 16, 18)

# tags
NEW_SUBFILE_TYPE, SUBFILE_TYPE, WIDTH, LENGTH, BITS_PER_SAMPLE, COMPRESSION, PHOTOMETRIC = 254, 255, 256, 257, 258, 259, 262
FILL_ORDER, DOCUMENT_NAME, DESCRIPTION, MAKE, MODEL, STRIP_OFFSETS, ORIENTATION, SAMPLES_PER_PIXEL = 266, 269, 270, 271, 272, 273, 274, 277
ROWS_PER_STRIP, STRIP_BYTE_COUNTS, X_RESOLUTION, Y_RESOLUTION, PLANAR, PAGE_NAME, T4_OPTIONS, T6_OPTIONS = 278, 279, 282, 283, 284, 285, 292, 293
RESOLUTION_UNIT, PAGE_NUMBER, SOFTWARE, DATE_TIME, ARTIST, HOST_COMPUTER, PREDICTOR, COLOR_MAP = 296, 297, 305, 306, 315, 316, 317, 320
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTE_COUNTS, SUB_IFDS, INK_SET, NUMBER_OF_INKS, EXTRA_SAMPLES = 322, 323, 324, 325, 330, 332, 334, 338
SAMPLE_FORMAT, S_MIN, S_MAX, JPEG_TABLES, JPEG_PROC, JPEG_START, JPEG_LENGTH, JPEG_RESTART = 339, 340, 341, 347, 512, 513, 514, 515
JPEG_Q_TABLES, JPEG_DC_TABLES, JPEG_AC_TABLES, YCBCR_COEFFICIENTS, YCBCR_SUBSAMPLING, YCBCR_POSITIONING, REFERENCE_BLACK_WHITE = 519, 520, 521, 529, 530, 531, 532
XMP, COPYRIGHT, EXIF, ICC_PROFILE, GPS = 700, 33432, 34665, 34675, 34853

COMPRESSIONS = {
    1: "none", 2: "ccitt_mh", 3: "ccitt_t4", 4: "ccitt_t6", 5: "lzw", 6: "jpeg_old", 7: "jpeg", 8: "deflate", 32773: "packbits", 50000: "zstd", 50001: "webp",
}
CODES = {name: code for code, name in COMPRESSIONS.items()}

WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, PALETTE, MASK, SEPARATED, YCBCR, CIELAB = 0, 1, 2, 3, 4, 5, 6, 8

MAX_PIXELS = 256 << 20
TEXT_FIELDS = {  # metadata column -> tag
    "document_name": 269, "image_description": 270, "make": 271, "model": 272, "page_name": 285, "software": 305, "date_time": 306,
    "artist": 315, "host_computer": 316, "copyright": 33432,
}
