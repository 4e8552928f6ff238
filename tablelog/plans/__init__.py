"""File skipping and the inspection of Catalyst plans."""
