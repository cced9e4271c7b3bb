"""The errors that the library raises, by family."""


class FitsError(Exception):
    """Any error about FITS data."""


def _family(base: str, *names: str) -> None:
    own = type(base, (FitsError,), {"__doc__": f"Errors of the family {base}."})
    globals()[base] = own
    for n in names:
        globals()[n] = type(n, (own,), {"__doc__": f"{n}, of the family {base}."})


_family("IoError", "ReadFailed", "WriteFailed", "EndOfFile", "NotWritable", "NotFound")
_family("HeaderError", "MissingEnd", "BadCard", "CardOverflow", "KeywordNotFound", "MissingRequiredKeyword", "BadKeyword", "DuplicateKeyword")
_family("ValueFormatError", "BadValue", "ValueUndefined", "WrongValueType")
_family("StructError", "BadBitpix", "BadNaxis", "BadDimensions", "BadExtension", "WrongHduType", "BadBlock", "TruncatedData")
_family("TableError", "BadTform", "BadTbcol", "BadTdim", "NoSuchColumn", "AmbiguousColumn", "RowOutOfRange", "BadDescriptor", "BadHeap", "FieldOverflow")
_family("ConversionError", "Overflow", "NanToInt", "PrecisionLoss", "NonFinite")
_family("ChecksumError", "ChecksumMismatch", "BadChecksum")
_family("CompressError", "UnsupportedCodec", "CorruptData", "BadTile", "BadQuantization")
_family("WcsError", "BadWcs", "NonInvertible", "UnsupportedProjection")
_family("LimitError", "LimitExceeded")
_family("FileNameError", "EmptyPath", "EmptyBracket", "UnbalancedBracket", "TrailingChars", "BadSection", "BadExtVer", "BadHduIndex", "DuplicateSelector", "UnsupportedFilter")


#: The widely used numeric status of each error; what is not listed is 412.
STATUS = {
    "EndOfFile": 107, "ReadFailed": 108, "WriteFailed": 106, "NotWritable": 112, "NotFound": 104, "BadCard": 207, "BadKeyword": 207, "BadValue": 207, "MissingEnd": 210, "CardOverflow": 207,
    "WrongValueType": 410, "ValueUndefined": 204, "KeywordNotFound": 202, "MissingRequiredKeyword": 225, "BadBitpix": 211, "BadNaxis": 212, "BadDimensions": 213, "WrongHduType": 235, "BadExtension": 225,
    "NoSuchColumn": 219, "AmbiguousColumn": 219, "BadTform": 261, "BadTdim": 263, "BadTbcol": 262, "RowOutOfRange": 307, "BadDescriptor": 264, "BadHeap": 264, "UnsupportedCodec": 413, "CorruptData": 414,
    "BadTile": 413, "BadQuantization": 413, "BadWcs": 502, "UnsupportedProjection": 504, "NonInvertible": 503,
}


def status(error: Exception | str) -> int:
    """The numeric status of an error or of its name; 0 for an empty name."""
    name = error if isinstance(error, str) else type(error).__name__
    return STATUS.get(name, 412) if name else 0
