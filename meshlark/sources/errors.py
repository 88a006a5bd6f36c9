"""What can be wrong with a file or a payload."""


class GribError(ValueError):
    """Any error of this package's readers and writers."""


class Truncated(GribError):
    """A section or payload ends too early."""


class BadMessage(GribError):
    """The section structure is broken, or a section that must be there isn't."""


class BadStream(GribError):
    """A packed payload contradicts its header."""


class Unsupported(GribError):
    """A template or option without a decoder here."""


class MissingMesh(GribError):
    """The coordinates of an unstructured grid's cells aren't known."""
