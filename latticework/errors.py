"""Errors of the engine."""


class EngineError(Exception):
    """Base of all."""


class ConfigError(EngineError):
    """A configuration is incomplete or out of range."""


class DataContractError(EngineError):
    """Input data breaks a stated contract."""


class WeightsError(EngineError):
    """Spatial weights cannot be built or used."""
