"""User-level queries: catalogue and snapshot cleaning, features, demand,
dashboard tables, attendance, model, timetable."""
