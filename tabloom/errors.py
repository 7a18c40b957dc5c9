"""The engine's one error class, with the return code that a caller can branch on."""


class VerbError(Exception):
    """A refused verb; the view it was applied to is as it was."""

    def __init__(self, message: str, code: int = 198):
        super().__init__(message)
        self.code = code


def not_found(name: str) -> VerbError:
    return VerbError(f"variable {name} not found", 111)
