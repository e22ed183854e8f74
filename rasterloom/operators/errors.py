"""The two ways in which a file can be refused."""


class RasterError(ValueError):
    status = "invalid"


class Invalid(RasterError):
    """The bytes break the format."""


class Unsupported(RasterError):
    """The bytes are well formed and ask for something this engine doesn't do."""

    status = "unsupported"
