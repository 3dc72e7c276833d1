"""Tools and a scripted investigation over an incident."""
