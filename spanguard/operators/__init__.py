"""DataFrame operators: detection, resolution, pseudonymization, restoration, audit, evaluation."""
