"""Exceptions that users meet."""


class TerravaneError(Exception):
    """A request that can't be carried out, with the reason."""


class GeometryError(ValueError):
    """Bytes, text or JSON that is no geometry."""


class MetadataError(TerravaneError):
    """The geometry metadata of a file can't be used."""


class NoMetadataError(MetadataError):
    """There is none."""


class DuplicateMetadataError(MetadataError):
    """There is more than one."""


class FeatureError(TerravaneError):
    """A GeoJSON text that breaks the format."""
