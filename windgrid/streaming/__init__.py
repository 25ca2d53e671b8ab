"""Extensions beyond batch: watermarked windows over an observation stream."""
