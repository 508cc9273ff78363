"""Runnable jobs: ``python -m jobs.recording_report`` and ``python -m jobs.text_release``, each with a config file."""
