"""Event streams: windowed counts with late data, and duplicates within the watermark."""
