"""What is fixed per sensor: bins, list sizes, columns, valid ranges and values that mean "none"."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")


@dataclass(frozen=True)
class Bins:
    """A bin axis in mm or m/s."""

    lower: np.ndarray
    upper: np.ndarray
    center: np.ndarray
    width: np.ndarray

    def __len__(self) -> int:
        return len(self.center)

    @staticmethod
    def of_edges(edges: np.ndarray, digits: int | None = None) -> Bins:
        """Bins between edges; centres and widths rounded to the digits that the maker gives."""
        edges = np.asarray(edges, float)
        center, width = (edges[:-1] + edges[1:]) / 2, np.diff(edges)
        if digits is not None:
            center, width = (np.floor(x * 10**digits + 0.5 + 1e-6) / 10**digits for x in (center, width))
        return Bins(edges[:-1], edges[1:], center, width)

    @staticmethod
    def of_widths(start: float, *runs: tuple[float, int]) -> Bins:
        """Bins of runs of equal width."""
        width = np.concatenate([np.full(n, w) for w, n in runs])
        edges = np.round(start + np.concatenate(([0.0], np.cumsum(width))), 6)
        return Bins(edges[:-1], edges[1:], np.round((edges[:-1] + edges[1:]) / 2, 6), width)


# Bin edges of sensors whose bins follow no rule.
_RD80_EDGES = (0.313, 0.405, 0.505, 0.596, 0.715, 0.827, 0.999, 1.232, 1.429, 1.582, 1.748, 2.077, 2.441, 2.727, 3.011, 3.385, 3.704, 4.127, 4.573, 5.145, 5.6)
_ODM470_EDGES = (
    0.0125, 0.0376, 0.0633, 0.0897, 0.1167, 0.1444, 0.1728, 0.2019, 0.2317, 0.2622, 0.2935, 0.3256, 0.3584, 0.3921, 0.4267, 0.462, 0.4983,
    0.5354, 0.5735, 0.6125, 0.6525, 0.6935, 0.7355, 0.7785, 0.8226, 0.8678, 0.9141, 0.9616, 1.0102, 1.0601, 1.1112, 1.1635, 1.2172, 1.2721,
    1.3285, 1.3862, 1.4454, 1.506, 1.5682, 1.6319, 1.6971, 1.764, 1.8325, 1.9028, 1.9748, 2.0485, 2.1241, 2.2016, 2.281, 2.3623, 2.4457,
    2.5312, 2.6187, 2.7085, 2.8004, 2.8947, 2.9912, 3.0902, 3.1916, 3.2956, 3.4021, 3.5113, 3.6231, 3.7378, 3.8553, 3.9756, 4.099, 4.2255,
    4.3551, 4.4878, 4.6239, 4.7634, 4.9063, 5.0528, 5.2029, 5.3567, 5.5143, 5.6759, 5.8414, 6.0111, 6.1849, 6.3631, 6.5457, 6.7328, 6.9245,
    7.1211, 7.3224, 7.5288, 7.7403, 7.9571, 8.1792, 8.4068, 8.6401, 8.8791, 9.1241, 9.3751, 9.6324, 9.8961, 10.1663, 10.4432, 10.727,
    11.0178, 11.3158, 11.6212, 11.9342, 12.2549, 12.5836, 12.9204, 13.2656, 13.6194, 13.9819, 14.3534, 14.7342, 15.1243, 15.5242, 15.934,
    16.3539, 16.7842, 17.2252, 17.6772, 18.1403, 18.615, 19.1014, 19.5999, 20.1107, 20.6342, 21.1707, 21.7205, 22.2838,
)
_SWS250_D = ((0.4, 1), (0.1, 10), (0.2, 1), (0.3, 1), (0.36, 1), (0.43, 1), (0.51, 1), (0.6, 1), (0.72, 1), (0.86, 1), (1.02, 1), (0.6, 1))
_SWS250_V = ((0.3, 1), (0.5, 1), (0.42, 1), (0.44, 1), (0.81, 1), (0.8, 1), (0.68, 1), (0.55, 1), (0.75, 1), (1.35, 1), (1.26, 1), (2.5, 1), (1.97, 1), (2.82, 1), (4.45, 1), (5.0, 1))
_PARSIVEL_STEPS = (10, 5, 5, 5, 5, 2)

# Sampling area in m2, sensor by sensor.
SAMPLING_AREA = {"PARSIVEL": 0.0054, "PARSIVEL2": 0.0054, "LPM": 0.0045, "LPM_V0": 0.0045, "ODM470": 0.00264, "PWS100": 0.004, "RD80": 0.005, "SWS250": 0.006504}
#: The order in which a telegram lists a spectrum of diameter (D) by velocity (V) bins.
LIST_ORDER = {"PARSIVEL": "VD", "PARSIVEL2": "VD", "LPM": "DV", "LPM_V0": "DV", "PWS100": "DV", "SWS250": "VD", "ODM470": "D", "RD80": "D"}
SENSORS = tuple(LIST_ORDER)
OPTICAL_SENSORS = tuple(s for s in SENSORS if s != "RD80")
WEATHER_COLUMNS = ("air_temperature", "relative_humidity", "wind_speed", "wind_direction")


def check_sensor(sensor: str) -> str:
    if sensor not in SENSORS:
        raise ValueError(f"{sensor} is no known sensor; known are {', '.join(SENSORS)}")
    return sensor


@lru_cache(maxsize=None)
def diameter_bins(sensor: str) -> Bins:
    """Diameter bins in mm."""
    check_sensor(sensor)
    if sensor in ("PARSIVEL", "PARSIVEL2"):
        width = np.repeat((0.125, 0.25, 0.5, 1.0, 2.0, 3.0), _PARSIVEL_STEPS)
        edges = np.concatenate(([0.0], np.cumsum(width)))
        # The maker sets the centres of the narrow bins to three digits, rounded down, and the edges halfway.
        center = np.where(np.arange(32) < 10, np.floor((edges[:-1] + width / 2) * 1000) / 1000, edges[:-1] + width / 2)
        edges[1:10] = np.round((center[:9] + center[1:10]) / 2, 4)
        return Bins(edges[:-1], edges[1:], center, width)
    if sensor == "LPM":
        return Bins.of_widths(0.125, (0.125, 3), (0.25, 6), (0.5, 12), (2.0, 1))
    if sensor == "LPM_V0":
        return Bins.of_widths(0.125, (0.125, 3), (0.25, 6), (0.5, 11))
    if sensor == "PWS100":
        return Bins.of_widths(0.0, (0.1, 10), (0.2, 5), (0.4, 5), (0.8, 5), (1.6, 5), (3.2, 4))
    if sensor == "SWS250":
        return Bins.of_widths(0.0, *_SWS250_D)
    return Bins.of_edges(np.array(_RD80_EDGES if sensor == "RD80" else _ODM470_EDGES), 3)


@lru_cache(maxsize=None)
def velocity_bins(sensor: str) -> Bins | None:
    """Velocity bins in m/s; None for sensors that measure none."""
    check_sensor(sensor)
    if sensor in ("PARSIVEL", "PARSIVEL2"):
        return Bins.of_widths(0.0, (0.1, 10), (0.2, 5), (0.4, 5), (0.8, 5), (1.6, 5), (3.2, 2))
    if sensor in ("LPM", "LPM_V0"):
        return Bins.of_widths(0.0, (0.2, 5), (0.4, 6), (0.8, 7), (1.0, 1), (2.0, 1))
    if sensor == "PWS100":
        return Bins.of_widths(0.0, (0.1, 10), (0.2, 5), (0.4, 5), (0.8, 5), (1.6, 5), (3.2, 4))
    if sensor == "SWS250":
        return Bins.of_widths(0.4, *_SWS250_V)
    return None


def sampling_area(sensor: str) -> float:
    """m2."""
    return SAMPLING_AREA[check_sensor(sensor)]


def effective_sampling_area(sensor: str, diameter_m: np.ndarray) -> np.ndarray:
    """m2 per bin: drops at the rim of a PARSIVEL's beam are not counted."""
    diameter_m = np.asarray(diameter_m, float)
    if check_sensor(sensor) in ("PARSIVEL", "PARSIVEL2"):
        return 0.18 * (0.03 - diameter_m / 2)
    return np.full(diameter_m.shape, sampling_area(sensor))


def effective_interval_factor(sensor: str) -> float:
    """Share of the sample interval in which the sensor measures."""
    return 0.9 if check_sensor(sensor) == "PWS100" else 1.0


def list_size(sensor: str) -> int:
    """Entries of a raw_drop_number list."""
    v = velocity_bins(sensor)
    return len(diameter_bins(sensor)) * (len(v) if v else 1)


def packed_sizes(sensor: str) -> dict[str, int]:
    """Entries per packed column of a telegram."""
    sizes = {"raw_drop_number": list_size(sensor)}
    if sensor in ("PARSIVEL", "PARSIVEL2"):
        sizes |= {"raw_drop_concentration": 32, "raw_drop_average_velocity": 32}
    if sensor == "RD80":
        sizes["ND"] = 20
    return sizes


def literal(values: np.ndarray) -> Column:
    """Bin constants as a literal array, folded once by the optimiser."""
    # One parsed expression instead of one call per number.
    return F.expr("array(" + ", ".join("double('NaN')" if x != x else f"{float(x)!r}D" for x in np.asarray(values, float).tolist()) + ")")


BINS_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("sensor_name", T.StringType()), ("axis", T.StringType()), ("idx", T.IntegerType()), ("center", T.DoubleType()), ("width", T.DoubleType()), ("lower", T.DoubleType()), ("upper", T.DoubleType()))]
)


def bins_table(spark: SparkSession, sensors: tuple[str, ...] = SENSORS) -> DataFrame:
    """The bins of sensors as a dimension table: sensor_name, axis (D or V), idx, center, width, lower, upper."""
    rows = []
    for sensor in sensors:
        for axis, bins in (("D", diameter_bins(sensor)), ("V", velocity_bins(sensor))):
            if bins is not None:
                rows += [(sensor, axis, i, *map(float, x)) for i, x in enumerate(zip(bins.center, bins.width, bins.lower, bins.upper))]
    return spark.createDataFrame(rows, BINS_SCHEMA)


# The columns of each sensor's telegrams; those in _TEXT are text, all others numbers.
_PARSIVEL = """rainfall_rate_32bit rainfall_accumulated_32bit weather_code_synop_4680 weather_code_synop_4677 weather_code_metar_4678 weather_code_nws
    reflectivity_32bit mor_visibility sample_interval laser_amplitude number_particles sensor_temperature sensor_serial_number firmware_iop firmware_dsp
    sensor_heating_current sensor_battery_voltage sensor_status start_time sensor_time sensor_date station_name station_number
    rainfall_amount_absolute_32bit error_code"""
_LPM_CLASSES = "hail solid_precipitation large_pellet small_pellet snowgrain rain small_rain drizzle"
_LPM_COUNTS = "number_particles number_particles_min_speed number_particles_max_speed number_particles_min_diameter number_particles_no_hydrometeor"
_COLUMNS = {
    "PARSIVEL": f"""{_PARSIVEL} rainfall_rate_16bit rainfall_rate_12bit rainfall_accumulated_16bit reflectivity_16bit
        raw_drop_concentration raw_drop_average_velocity raw_drop_number""",
    "PARSIVEL2": f"""{_PARSIVEL} sensor_temperature_pcb sensor_temperature_receiver sensor_temperature_trasmitter rainfall_rate_16_bit_30
        rainfall_rate_16_bit_1200 rainfall_accumulated_16bit reflectivity_16bit rain_kinetic_energy snowfall_rate number_particles_all list_particles
        raw_drop_concentration raw_drop_average_velocity raw_drop_number air_temperature relative_humidity wind_speed wind_direction""",
    "LPM": """weather_code_synop_4677_5min weather_code_synop_4680_5min weather_code_metar_4678_5min precipitation_rate_5min weather_code_synop_4677
        weather_code_synop_4680 weather_code_metar_4678 precipitation_rate rainfall_rate snowfall_rate precipitation_accumulated mor_visibility
        reflectivity quality_index max_hail_diameter laser_status static_signal_status laser_temperature_analog_status
        laser_temperature_digital_status laser_current_analog_status laser_current_digital_status sensor_voltage_supply_status
        current_heating_pane_transmitter_head_status current_heating_pane_receiver_head_status temperature_sensor_status
        current_heating_voltage_supply_status current_heating_house_status current_heating_heads_status current_heating_carriers_status
        control_output_laser_power_status reserved_status temperature_interior laser_temperature laser_current_average control_voltage
        optical_control_voltage_output sensor_voltage_supply current_heating_pane_transmitter_head current_heating_pane_receiver_head
        temperature_ambient current_heating_voltage_supply current_heating_house current_heating_heads current_heating_carriers"""
    + "".join(f" {c} {c}_internal_data" for c in f"{_LPM_COUNTS} number_particles_class_9".split())
    + "".join(f" number_particles_{c} total_gross_volume_{c}" for c in f"unknown_classification {_LPM_CLASSES}".split())
    + " raw_drop_number air_temperature relative_humidity wind_speed wind_direction",
    "LPM_V0": """weather_code_synop_4680_5min weather_code_metar_4678_5min precipitation_rate_5min weather_code_synop_4680 weather_code_metar_4678
        precipitation_rate precipitation_accumulated temperature_interior laser_temperature laser_current_average control_voltage
        optical_control_voltage_output"""
    + "".join(f" {c} {c}_internal_data" for c in _LPM_COUNTS.split())
    + "".join(f" number_particles_{c} total_gross_volume_{c}" for c in f"unknown_classification {_LPM_CLASSES}".split())
    + " raw_drop_number air_temperature relative_humidity wind_speed wind_direction",
    "ODM470": """reference_voltage precipitation_rate precip_flag relative_wind_speed relative_wind_direction weather_code_synop_4677 raw_drop_number
        air_temperature relative_humidity wind_speed wind_direction""",
    "RD80": "sensor_status sample_interval RI RA RAT W Wg Z ZdB EK EF N0 slope Dmax ND raw_drop_number",
    "PWS100": """mor_visibility weather_code_synop_4680 weather_code_metar_4678 weather_code_nws alarms sensor_status air_temperature
        relative_humidity wetbulb_temperature air_temperature_max air_temperature_min rainfall_rate rainfall_accumulated average_drop_velocity
        average_drop_size raw_drop_number type_distribution drop_size_distribution peak_to_pedestal_hist""",
    "SWS250": """precipitation_rate precipitation_accumulated weather_code_synop_4680 weather_code_metar_4678 past_weather1 past_weather2
        mor_visibility_5min mor_visibility number_particles sensor_temperature obstruction_status total_extinction_coefficient
        transmissometer_extinction_coefficient back_scatter_extinction_coefficient ambient_light_sensor_signal sensor_status
        ambient_light_sensor_signal_status raw_drop_number""",
}
_TEXT = re.compile(
    r"weather_code_(metar|nws).*|sensor_serial_number|firmware_\w+|start_time|sensor_time|sensor_date|station_\w+|list_particles|raw_drop_\w+|ND|alarms"
    r"|type_distribution|drop_size_distribution|peak_to_pedestal_hist|past_weather\d|obstruction_status|sensor_voltage_supply"
    r"|current_heating_(pane_(transmitter|receiver)_head|voltage_supply|house|heads|carriers)"
)

# Valid range by column, for all sensors; None is no limit. Later patterns count first.
_RANGES: tuple[tuple[str, float, float], ...] = (
    (r"rainfall_rate_(32|16)bit", 0, 9999.999),
    (r"rainfall_accumulated_32bit", 0, 9999.0),
    (r"weather_code_synop_4680", 0, 89),
    (r"weather_code_synop_4677", 0, 90),
    (r"reflectivity_32bit", -9.999, 99.999),
    (r"mor_visibility", 0, 20000),
    (r"sample_interval", 0, 3600),
    (r"laser_amplitude|number_particles", 0, 99999),
    (r"sensor_temperature(_\w+)?", -99, 100),
    (r"sensor_heating_current", 0, 4.0),
    (r"sensor_battery_voltage", 0, 30.0),
    (r"sensor_status|error_code", 0, 3),
    (r"rainfall_amount_absolute_32bit", 0, 999.999),
    (r"rainfall_accumulated_16bit", 0, 300.0),
    (r"reflectivity_16bit", -9.99, 99.99),
    (r"rainfall_rate_16_bit_30", 0, 30),
    (r"rainfall_rate_16_bit_1200", 0, 1200),
    (r"rain_kinetic_energy", 0, 9999.99),
    (r"snowfall_rate|rainfall_rate|precipitation_rate(_5min)?", 0, 999.999),
    (r"number_particles_all", 0, 8192),
    (r"air_temperature", -40, 70),
    (r"relative_humidity", 0, 99999),
    (r"wind_speed", 0, 60),
    (r"wind_direction", 0, 360),
)
_LPM_RANGES = (
    (r"weather_code_synop_4677(_5min)?", -4, 90),
    (r"weather_code_synop_4680(_5min)?", -1, 89),
    (r"precipitation_accumulated", 0, 9999.99),
    (r"mor_visibility", 0, 99999),
    (r"reflectivity", -9.9, 99.9),
    (r"quality_index", 0, 100),
    (r"max_hail_diameter", 0, 9.9),
    (r"\w+_status", 0, 1),
    (r"reserved_status", 0, 0),
    (r"temperature_interior", -30, 999),
    (r"laser_temperature", 0, 80),
    (r"laser_current_average|optical_control_voltage_output", 0, 9999),
    (r"temperature_ambient", -999.9, 99999),
    (r"number_particles_\w+", 0, 99999),
    (r"number_particles\w*_internal_data|total_gross_volume_\w+", 0, 99999.999),
)
_OWN_RANGES: dict[str, tuple[tuple[str, float, float], ...]] = {
    "PARSIVEL": ((r"mor_visibility", 0, 9999),),
    "LPM": _LPM_RANGES,
    "LPM_V0": _LPM_RANGES,
    "ODM470": ((r"reference_voltage", 0, 5.5), (r"relative_wind_speed", 0, 100), (r"relative_wind_direction", 0, 360), (r"precip_flag", -1, 5)),
    "RD80": (
        (r"sample_interval", 0, 9999), (r"RI", 0, 999.9999), (r"RA|RAT|W|Wg|Dmax", 0, 9.9999), (r"Z|ZdB", -99.9999, 99.9999), (r"EF|EK", 0, 9999.999),
    ),
    "PWS100": (
        (r"sensor_status", 0, 4), (r"air_temperature(_\w+)?|wetbulb_temperature", -99.9, 99.9), (r"relative_humidity", 0, 100), (r"rainfall_rate|rainfall_accumulated", 0, 99999),
    ),
    "SWS250": (
        (r"precipitation_rate", 0, 9999.999), (r"precipitation_accumulated", 0, 9999), (r"number_particles", 0, 9999),
        (r"(total|transmissometer)_extinction_coefficient", 0, 999.99), (r"back_scatter_extinction_coefficient", -999.99, 999.99), (r"ambient_light_sensor_signal", 0, 99998),
    ),
}
# Numbers that mean "no value", by column.
_FLAGS: tuple[tuple[str, tuple[float, ...]], ...] = (
    (r"rainfall_rate_(32|16)bit", (9999.999,)),
    (r"rainfall_accumulated_32bit", (9999.0,)),
    (r"reflectivity_32bit", (99.999, -9.999)),
    (r"reflectivity_16bit", (99.99,)),
    (r"laser_amplitude", (99999,)),
    (r"rainfall_amount_absolute_32bit", (999.999,)),
    (r"rain_kinetic_energy", (9999.99,)),
    (r"air_temperature|relative_humidity", (99999,)),
    (r"wind_direction", (999,)),
)
_LPM_FLAGS = (
    (r"weather_code_synop_\w+", (-1,)),
    (r"precipitation_rate(_5min)?|rainfall_rate|snowfall_rate", (999.999,)),
    (r"temperature_interior|quality_index", (999,)),
    (r"precipitation_accumulated", (9999.99,)),
    (r"reflectivity", (99.9,)),
    (r"temperature_ambient", (99999,)),
)
_OWN_FLAGS = {
    "PARSIVEL": ((r"number_particles", (99999,)),),
    "PARSIVEL2": ((r"number_particles", (99999,)), (r"snowfall_rate", (999.999,))),
    "LPM": (*_LPM_FLAGS, (r"laser_current_average|optical_control_voltage_output", (9999,))),
    "LPM_V0": _LPM_FLAGS,
    "SWS250": ((r"ambient_light_sensor_signal", (99999,)),),
}
# Texts that mean "no value".
TEXT_FLAGS = {"LPM_V0": {"weather_code_metar_4678": ("?????",), "weather_code_metar_4678_5min": ("?????",)}, "RD80": {"Z": ("-Inf",), "ZdB": ("-Inf",)}}
_VALID = {
    "PARSIVEL": {"sensor_status": (0, 1, 2, 3), "error_code": (0, 1, 2)},
    "PARSIVEL2": {"sensor_status": (0, 1, 2, 3), "error_code": (0, 1, 2)},
    "RD80": {"sensor_status": (0, 1)},
    "PWS100": {"sensor_status": (0, 1, 2, 3, 4)},
}


# Status columns of the LPM whose values are not checked, and text columns of single sensors.
_ANY_STATUS = ("static_signal_status", "current_heating_pane_transmitter_head_status")
_OWN_TEXT = {"SWS250": ("sensor_status", "ambient_light_sensor_signal_status")}
# Columns of single sensors that have no range or flag although others have.
_NO_RANGE = {"SWS250": ("mor_visibility",), "RD80": ("sensor_status",)}
_NO_FLAG = {"PWS100": ("air_temperature", "relative_humidity")}


def columns(sensor: str) -> list[str]:
    """The columns that a sensor's L0A table may hold besides time and place."""
    return _COLUMNS[check_sensor(sensor)].split()


def l0a_dtypes(sensor: str) -> dict[str, str]:
    return {c: "string" if _TEXT.fullmatch(c) or c in _OWN_TEXT.get(sensor, ()) else "float" for c in columns(sensor)}


def l0a_schema(sensor: str) -> T.StructType:
    kinds = {"string": T.StringType(), "float": T.FloatType()}
    return T.StructType([T.StructField("time", T.TimestampType()), *[T.StructField(c, kinds[k]) for c, k in l0a_dtypes(sensor).items()]])


def _matching(rules, column: str):
    found = None
    for pattern, *value in rules:
        if re.fullmatch(pattern, column):
            found = value
    return found


def data_ranges(sensor: str) -> dict[str, tuple[float, float]]:
    out = {}
    for column, kind in l0a_dtypes(sensor).items():
        found = (_matching(_OWN_RANGES.get(sensor, ()), column) or _matching(_RANGES, column)) if kind == "float" and column not in _NO_RANGE.get(sensor, ()) else None
        if found:
            out[column] = (float(found[0]), float(found[1]))
    return out


def nan_flags(sensor: str) -> dict[str, tuple[float, ...]]:
    out = {}
    for column, kind in l0a_dtypes(sensor).items():
        found = (_matching(_OWN_FLAGS.get(sensor, ()), column) or _matching(_FLAGS, column)) if kind == "float" and column not in _NO_FLAG.get(sensor, ()) else None
        if found:
            out[column] = tuple(float(x) for x in found[0])
    return out


def valid_values(sensor: str) -> dict[str, tuple[float, ...]]:
    if check_sensor(sensor) == "LPM":
        return {c: (0.0, 1.0) for c in columns(sensor) if c.endswith("_status") and c not in _ANY_STATUS}
    return {c: tuple(map(float, v)) for c, v in _VALID.get(sensor, {}).items()}


def check_sensor_configuration(sensor: str) -> None:
    """Raises if what is fixed for a sensor contradicts itself."""
    d, v = diameter_bins(sensor), velocity_bins(sensor)
    for bins in (d, v):
        if bins is not None and not (np.all(bins.upper > bins.lower) and np.allclose(bins.lower[1:], bins.upper[:-1])):
            raise ValueError(f"the bins of {sensor} overlap or leave gaps")
    if (v is None) != (LIST_ORDER[sensor] == "D"):
        raise ValueError(f"the list order of {sensor} does not fit its bins")
    for column, (low, high) in data_ranges(sensor).items():
        if low > high:
            raise ValueError(f"the range of {column} of {sensor} is empty")
