"""An extension: journeys as second-leg flights arrive."""
