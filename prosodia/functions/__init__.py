"""Functions of the spoken-text and speech-signal engine."""
