"""Thresholds that are part of the operators' meaning, in points unless named otherwise."""

# Axis rules and touching.
AXIS, TOUCH, MIN_RULE = 1.5, 2.0, 6.0
# Lines: rows looked back on, baseline tolerance, gap that splits a row, gap that reads as a space.
ROWS_BACK, BASELINE_MIN, BASELINE_SHARE = 4, 1.5, 0.28
GAP_MIN, GAP_SHARE, SPACE_SHARE = 18.0, 2.5, 0.16
MAIN_SIZE_SHARE = 0.85
# Paragraph breaks.
GAP_WIDE, GAP_TIGHT, SIZE_CHANGE, INDENT, SHORT_LINE, JUMP, HANGING = 1.8, 0.55, 0.18, 0.8, 0.72, 3.0, 5.0
HEADING, CENTRE_MIN, CENTRE_SHARE = 1.2, 3.0, 0.5
# Tables.
X_LINES, Y_LINES, GRID_TOLERANCE = (3, 41), (3, 201), 2.0
# Footers and gutters.
FOOTER_FROM = 0.92
GUTTER_MIN, GUTTER_SHARE = 3.0, 0.25
# Confidence.
WORST, WORST_CHARS, WORST_LINES = 88, 6, 20
# Papers (width, height) in points: A4, A3, A5 from millimetres, Letter.
MM = 72 / 25.4
PAPERS = (("A4", 210 * MM, 297 * MM), ("A3", 297 * MM, 420 * MM), ("A5", 148 * MM, 210 * MM), ("Letter", 612.0, 792.0))
PAPER_MIN, PAPER_SHARE = 3.0, 0.01
# Limits of the page tools.
MIB = 1024 * 1024
MERGE_FILES, MERGE_BYTES, MERGE_PAGES = 30, 160 * MIB, 900
SPLIT_GROUPS, SPLIT_PAGES, FILE_BYTES, FILE_PAGES = 100, 600, 64 * MIB, 600
IMAGE_FILES, IMAGE_PIXELS, IMAGE_EDGE = 100, 16_000_000, 8192
HEADER_PIXELS, HEADER_EDGE = 40_000_000, 16_384
RESULT_BYTES = 128 * MIB
