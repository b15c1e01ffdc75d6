"""wattloom: device-telemetry analytics as pure DataFrame transformations."""
