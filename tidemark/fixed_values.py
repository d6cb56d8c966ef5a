"""Ids, limits, column names and modelling assumptions.

These must hold as they are for results to be right. Everything that is a
choice of the caller is a function parameter elsewhere; these are its defaults.
"""

# Parts of the day: name, first minute (inclusive), last minute (exclusive).
TIME_BLOCKS = (
    ("early", 0, 420),
    ("am", 420, 600),
    ("midday", 600, 960),
    ("pm", 960, 1140),
    ("evening", 1140, 1440),
)
WHOLE_DAY = "day"

# Top bins; each means "this or more".
TOP_MINUTE = 180
TOP_DOLLAR = 300

# A trip is kept when 0 < seconds < LONGEST_TRIP_S and 0 <= fare <= HIGHEST_FARE.
LONGEST_TRIP_S = 6 * 60 * 60
HIGHEST_FARE = 500

# Cells with fewer observations are not reported.
SAMPLE_FLOOR = 30
# Segment blocks with fewer month-weekday-hour rows are not reported.
SEGMENT_ROW_FLOOR = 10

# Duration column against timestamp gap, as a ratio; only longer trips are looked at.
UNIT_RATIO_BOUNDS = (0.5, 2.0)
UNIT_RATIO_MIN_SECONDS = 600
# Stated against implied segment minutes: the larger of the two allowances.
SEGMENT_UNIT_ABSOLUTE = 0.5
SEGMENT_UNIT_RELATIVE = 0.05
SEGMENT_UNIT_MIN_ROWS = 10

# Differences under this many minutes are a draw.
DRAW_MINUTES = 5

AIRPORT_NAMES = {132: "JFK", 138: "LGA", 1: "EWR"}
LICENCE_NAMES = {"HV0003": "Uber", "HV0005": "Lyft"}
PLACEHOLDER_BOROUGHS = ("Unknown", "N/A")
WORKING_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")

# Fares in dollars for a whole transit journey, by airport.
TRANSIT_FARES = {"JFK": 11.75, "LGA": 3.00}

# Modelled legs, minutes, both ends included.
TRANSFER_RANGE = (3, 8)
AIRTRAIN_WAIT_RANGE = (0, 10)
BUS_WAIT_RANGE = (0, 12)

# Rail links: airport, feeder routes, connector station, link, ride range, wait range.
# A ride range of None is taken from the measured segment.
RAIL_LINKS = (
    ("JFK", ("A",), "Howard Beach-JFK Airport", "AirTrain", (10, 15), AIRTRAIN_WAIT_RANGE),
    ("JFK", ("E", "J", "Z"), "Sutphin Blvd-Archer Av-JFK Airport", "AirTrain", (8, 12), AIRTRAIN_WAIT_RANGE),
    ("LGA", ("7",), "74 St-Broadway", "Q70+", None, BUS_WAIT_RANGE),
    ("LGA", ("E", "F", "M", "R"), "Jackson Hts-Roosevelt Av", "Q70+", None, BUS_WAIT_RANGE),
)

# Airport-bound bus segments: route, direction, stop order, junction, aliases, terminal.
SEGMENT_LEGS = (
    ("Q70+", "N", 2, "74 St-Broadway", ("Jackson Hts-Roosevelt Av", "74 St-Broadway"), "LaGuardia Terminal C"),
    ("M60+", "E", 9, "125 St", ("125 St",), "LaGuardia"),
)

# The published cell the cohort report is set against.
COHORT_HOUR = 10
COHORT_BASELINE_MINUTES = 38

# Map drawing.
SIMPLIFY_TOLERANCE = 0.0002
SLIVER_SHARE = 0.001
FRAME_UNITS = 1000
OFF_FRAME_ZONES = (1,)
TAP_RADIUS_PIXELS = 22
SHADE_BREAKS = (0.2, 0.4, 0.6, 0.8)

# How well each side of a comparison is measured.
CAR_EVIDENCE = "recorded trips"
LINK_EVIDENCE = {
    "JFK": "measured ride, modelled link",
    "LGA": "measured ride, hourly bus averages",
}
