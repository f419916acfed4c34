"""PROJJSON objects: what each kind of CRS, datum or operation must and may hold, level by level.

Written after the published format as a table of kinds, so nothing is fetched. A member that no kind
knows is an error, as is a missing one or one of another type.
"""

from __future__ import annotations

from collections.abc import Callable

Check = Callable[[object], bool]
_USAGE = "$schema scope area bbox vertical_extent temporal_extent usages remarks id ids".split()


def _text(v) -> bool:
    return isinstance(v, str)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _bool(v) -> bool:
    return isinstance(v, bool)


def _list(of: Check) -> Check:
    return lambda v: isinstance(v, list) and all(map(of, v))


def _either(*checks: Check) -> Check:
    return lambda v: any(c(v) for c in checks)


def _one(*kinds: str) -> Check:
    """An object of one of the kinds."""
    return lambda v: any(fits(v, k) for k in kinds)


def _object(required: str, **members: Check) -> Check:
    def check(v) -> bool:
        return isinstance(v, dict) and set(required.split()) <= v.keys() <= members.keys() and all(members[k](x) for k, x in v.items())

    return check


_identifier = _object("authority code", authority=_text, code=_either(_text, _number), version=_either(_text, _number), authority_citation=_text, uri=_text)
_unit = _either(lambda v: v in ("metre", "degree", "unity"), _object("type name conversion_factor", type=_text, name=_text, conversion_factor=_number, id=_identifier, ids=_list(_identifier)), _object("type name", type=_text, name=_text, id=_identifier, ids=_list(_identifier)))
_value = _either(_number, _object("value unit", value=_number, unit=_unit))
_DIRECTIONS = "north northNorthEast northEast eastNorthEast east eastSouthEast southEast southSouthEast south southSouthWest southWest westSouthWest west westNorthWest northWest northNorthWest up down geocentricX geocentricY geocentricZ columnPositive columnNegative rowPositive rowNegative displayRight displayLeft displayUp displayDown forward aft port starboard clockwise counterClockwise towards awayFrom future past unspecified".split()
_SUBTYPES = "Cartesian spherical ellipsoidal vertical ordinal parametric affine TemporalDateTime TemporalCount TemporalMeasure".split()
_box = _object("east_longitude west_longitude south_latitude north_latitude", east_longitude=_number, west_longitude=_number, south_latitude=_number, north_latitude=_number)
_meridian = _object("longitude", longitude=_value)
_named = {"name": _text, "id": _identifier, "ids": _list(_identifier)}
_axis = _object(
    "name abbreviation direction", type=lambda v: v == "Axis", name=_text, abbreviation=_text, direction=lambda v: v in _DIRECTIONS, meridian=lambda v: isinstance(v, dict) and _meridian({k: x for k, x in v.items() if k not in ("type", "id", "ids")}),
    unit=_unit, minimum_value=_number, maximum_value=_number, range_meaning=lambda v: v in ("exact", "wraparound"), id=_identifier, ids=_list(_identifier),
)
_system = _object("subtype axis", type=lambda v: v == "CoordinateSystem", name=_text, subtype=lambda v: v in _SUBTYPES, axis=_list(_axis), id=_identifier, ids=_list(_identifier), **{"$schema": _text})
_method = _object("name", type=lambda v: v == "OperationMethod", **_named)
_parameter = _object("name value", type=lambda v: v == "ParameterValue", value=_either(_text, _number), unit=_unit, **_named)
_conversion = _object("name method", type=lambda v: v == "Conversion", method=_method, parameters=_list(_parameter), **_named, **{"$schema": _text})
_abridged = _object("name method parameters", type=lambda v: v == "AbridgedTransformation", method=_method, parameters=_list(_parameter), source_crs=_one("crs"), **_named, **{"$schema": _text})
_extent = lambda v: isinstance(v, dict)
_usage: dict[str, Check] = {
    "$schema": _text, "scope": _text, "area": _text, "bbox": _box, "vertical_extent": _extent, "temporal_extent": _extent, "usages": _list(_extent), "remarks": _text, "id": _identifier, "ids": _list(_identifier),
}
assert set(_usage) == set(_USAGE)


class _Kind:
    """types: what `type` may say; required; members beside `type`, `name` and those of a usage;
    exactly: groups of members of which just one must be there."""

    def __init__(self, types: str, required: str, exactly: tuple[str, ...] = (), **members: Check):
        self.types, self.required, self.exactly = types.split(), required.split(), exactly
        self.members = {"type": lambda v: v in self.types, "name": _text, **_usage, **members}

    def missing(self, v: dict) -> list[str]:
        return [m for m in self.required if m not in v]

    def fits(self, v) -> bool:
        if not isinstance(v, dict) or self.missing(v) or not v.keys() <= self.members.keys() or "id" in v and "ids" in v:
            return False
        if any(sum(m in v for m in group.split()) != 1 for group in self.exactly):
            return False
        return all(self.members[k](x) for k, x in v.items())


def _derived(types: str, base: str, **more: Check) -> _Kind:
    return _Kind(types, "name base_crs conversion coordinate_system", base_crs=_one(base), conversion=_conversion, coordinate_system=_system, **more)


_KINDS = {
    "bound": _Kind("BoundCRS", "source_crs target_crs transformation", source_crs=_one("crs"), target_crs=_one("crs"), transformation=_abridged),
    "compound": _Kind("CompoundCRS", "name components", components=_list(_one("crs"))),
    "derived_engineering": _derived("DerivedEngineeringCRS", "engineering"),
    "derived_geodetic": _derived("DerivedGeodeticCRS DerivedGeographicCRS", "geodetic"),
    "derived_parametric": _derived("DerivedParametricCRS", "parametric"),
    "derived_projected": _derived("DerivedProjectedCRS", "projected"),
    "derived_temporal": _derived("DerivedTemporalCRS", "temporal"),
    "derived_vertical": _derived("DerivedVerticalCRS", "vertical"),
    "engineering": _Kind("EngineeringCRS", "name datum", datum=_one("engineering_datum"), coordinate_system=_system),
    "geodetic": _Kind("GeodeticCRS GeographicCRS", "name", ("datum datum_ensemble",), datum=_one("geodetic_frame", "dynamic_geodetic_frame"), datum_ensemble=_one("ensemble"), coordinate_system=_system, deformation_models=_list(_extent)),
    "parametric": _Kind("ParametricCRS", "name datum", datum=_one("parametric_datum"), coordinate_system=_system),
    "projected": _Kind("ProjectedCRS", "name base_crs conversion coordinate_system", base_crs=_one("geodetic"), conversion=_conversion, coordinate_system=_system),
    "temporal": _Kind("TemporalCRS", "name datum", datum=_one("temporal_datum"), coordinate_system=_system),
    "vertical": _Kind("VerticalCRS", "name", ("datum datum_ensemble",), datum=_one("vertical_frame", "dynamic_vertical_frame"), datum_ensemble=_one("ensemble"), coordinate_system=_system, geoid_model=_extent, geoid_models=_list(_extent), deformation_models=_list(_extent)),
    "geodetic_frame": _Kind("GeodeticReferenceFrame", "name ellipsoid", anchor=_text, anchor_epoch=_number, ellipsoid=_one("ellipsoid"), prime_meridian=_one("prime_meridian")),
    "dynamic_geodetic_frame": _Kind("DynamicGeodeticReferenceFrame", "name ellipsoid frame_reference_epoch", anchor=_text, anchor_epoch=_number, ellipsoid=_one("ellipsoid"), prime_meridian=_one("prime_meridian"), frame_reference_epoch=_number, deformation_model=_text),
    "vertical_frame": _Kind("VerticalReferenceFrame", "name", anchor=_text, anchor_epoch=_number),
    "dynamic_vertical_frame": _Kind("DynamicVerticalReferenceFrame", "name frame_reference_epoch", anchor=_text, anchor_epoch=_number, frame_reference_epoch=_number, deformation_model=_text),
    "engineering_datum": _Kind("EngineeringDatum", "name", anchor=_text),
    "parametric_datum": _Kind("ParametricDatum", "name", anchor=_text),
    "temporal_datum": _Kind("TemporalDatum", "name calendar", calendar=_text, time_origin=_text),
    "ensemble": _Kind("DatumEnsemble", "name members accuracy", members=_list(_object("name", **_named)), ellipsoid=_one("ellipsoid"), accuracy=_text),
    "ellipsoid": _Kind("Ellipsoid", "name", ("radius semi_major_axis",), semi_major_axis=_value, semi_minor_axis=_value, inverse_flattening=_number, radius=_value),
    "prime_meridian": _Kind("PrimeMeridian", "name longitude", longitude=_value),
    "single_operation": _Kind("Conversion Transformation", "name method", source_crs=_one("crs"), target_crs=_one("crs"), interpolation_crs=_one("crs"), method=_method, parameters=_list(_parameter), accuracy=_text),
    "concatenated_operation": _Kind("ConcatenatedOperation", "name source_crs target_crs steps", source_crs=_one("crs"), target_crs=_one("crs"), steps=_list(_extent), accuracy=_text),
    "coordinate_metadata": _Kind("CoordinateMetadata", "crs", crs=_one("crs"), coordinateEpoch=_number),
}
_CRS = list(_KINDS)[:14]


def fits(v, kind: str) -> bool:
    if kind == "crs":
        return any(_KINDS[k].fits(v) for k in _CRS)
    return _KINDS[kind].fits(v)


def problem(v: dict) -> str:
    """Empty for a PROJJSON object; else what is wrong with it as the kind its `type` names or, where
    that is none, as the first kind there is."""
    if any(k.fits(v) for k in _KINDS.values()):
        return ""
    named = next((k for k in _KINDS.values() if isinstance(v.get("type"), str) and v["type"] in k.types), _KINDS["bound"])
    if missing := named.missing(v):
        return f"input is invalid: missing properties: {', '.join(map(repr, missing))}"
    for group in named.exactly:
        if sum(m in v for m in group.split()) != 1:
            return f"input is invalid: expected one of {', '.join(map(repr, group.split()))}"
    if extra := sorted(v.keys() - named.members.keys()):
        return f"input is invalid: additionalProperties {', '.join(map(repr, extra))} not allowed"
    wrong = next((k for k in sorted(v) if not named.members[k](v[k])), "")
    return f"/{wrong} is invalid" if wrong else "input is invalid: both 'id' and 'ids'"
